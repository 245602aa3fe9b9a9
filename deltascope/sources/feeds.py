"""Readers of filing feeds, news feeds and landed files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The parallel arrays of a submissions feed, in the names of its JSON.
RECENT = ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument", "primaryDocDescription", "items", "size")
#: Order of exchanges in the company universe; others come last.
EXCHANGES = ("NYSE", "Nasdaq", "CBOE", "OTC")


def read_json(spark: SparkSession, path: str, schema: str | None = None, malformed: str = "PERMISSIVE") -> DataFrame:
    """JSON lines; ``malformed="DROPMALFORMED"`` skips broken lines, which needs a schema."""
    reader = spark.read.option("mode", malformed)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    out = spark.read.csv(path, header=True, schema=schema)
    return out.fillna(defaults) if defaults else out


def ticker_map(records: DataFrame) -> DataFrame:
    """(ticker, cik, name) of records cik_str, ticker, title: the first record (smallest cik) of each ticker wins."""
    own = records.select(normalize_ticker(F.col("ticker")).alias("ticker"), F.col("cik_str").cast("long").alias("cik"), F.col("title").alias("name"))
    return own.groupBy("ticker").agg(F.min(F.struct("cik", "name")).alias("s")).select("ticker", F.lpad(F.col("s.cik").cast("string"), 10, "0").alias("cik10"), "s.cik", "s.name")


def normalize_ticker(t: Column) -> Column:
    return F.translate(F.upper(F.trim(t)), ".", "-")


def normalize_accession(a: Column) -> Column:
    """Dashed accession number, null where it is none."""
    out = F.regexp_replace(F.trim(a), r"^(\d{10})-?(\d{2})-?(\d{6})$", "$1-$2-$3")
    return F.when(out.rlike(r"^\d{10}-\d{2}-\d{6}$"), out)


def submissions(feed: DataFrame, recent: str = "filings.recent") -> DataFrame:
    """Rows of a feed's parallel arrays; short arrays are filled with nulls."""
    # a null array counts as an empty one; alone it would void the whole zip
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"{recent}.{c}"), F.array()).alias(c) for c in RECENT])
    rows = feed.select(F.col("cik").cast("long").alias("cik"), F.inline(zipped))
    form = F.upper(F.trim("form"))
    raw = F.regexp_replace("primaryDocument", r"^xsl[^/]*/", "")
    return rows.select("cik", normalize_accession(F.col("accessionNumber")).alias("accession"), F.col("form"), F.regexp_replace(form, "/A$", "").alias("base_form"), form.rlike("/A$").alias("is_amendment"),
                       F.try_to_date("filingDate").alias("filed"), F.try_to_date("reportDate").alias("period"), raw.alias("document"), F.filter(F.split("items", ","), lambda x: x != "").alias("items"))


def select_filings(rows: DataFrame, forms: list[str], since: str | None = None, limit: int | None = None) -> DataFrame:
    """Filings of the base forms (amendments kept) with a document, since a date, newest first."""
    out = rows.where(F.col("base_form").isin([f.upper() for f in forms]) & (F.coalesce("document", F.lit("")) != ""))
    if since:
        out = out.where(F.col("filed") >= F.lit(since).cast("date"))
    out = out.orderBy(F.desc("filed"), F.desc("accession"))
    return out.limit(limit) if limit else out


def universe(rows: DataFrame) -> DataFrame:
    """(cik, name, ticker, exchange) once a ticker, by exchange then ticker."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in EXCHANGES]), F.col("exchange")), F.lit(0)), F.lit(len(EXCHANGES) + 1))
    own = rows.where(F.coalesce("ticker", F.lit("")) != "").withColumn("place", place)
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("place", "cik"))).where("k = 1")
    return first.orderBy("place", "ticker").select("cik", "name", "ticker", "exchange")


def all_submissions(feed: DataFrame, pages: DataFrame, recent: str = "filings.recent", page: str = "page") -> DataFrame:
    """Rows of a feed and of its continuation pages (cik and the parallel arrays in column ``page``), once each."""
    rows = submissions(feed, recent).unionByName(submissions(pages, page))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("cik", "accession", "document").orderBy("filed"))).where("_k = 1").drop("_k")


def facts(feed: DataFrame) -> DataFrame:
    """(cik, taxonomy, concept, unit, ended, form, val) of company facts, nested as facts > taxonomy > concept > units > unit."""
    concepts = feed.select("cik", F.explode("facts").alias("taxonomy", "c")).select("cik", "taxonomy", F.explode("c").alias("concept", "u"))
    values = concepts.select("cik", "taxonomy", "concept", F.explode("u.units").alias("unit", "v")).select("cik", "taxonomy", "concept", "unit", F.explode("v").alias("x"))
    return values.select("cik", "taxonomy", "concept", "unit", F.try_to_date("x.end").alias("ended"), "x.form", "x.val")


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries: id, company, cik, form, accession, updated. Titles read ``form - company (cik)`` or ``company (cik) [form]``."""
    own = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, updated string, summary string").load(path)
    first, second = r"^\s*(\S+) - (.*?) \((\d{10})\)", r"^\s*(.*?) \((\d{10})\) \[([^\]]+)\]"
    either = lambda a, b: F.coalesce(F.nullif(F.regexp_extract("title", first, a), F.lit("")), F.regexp_extract("title", second, b))
    return own.select(F.md5("id").alias("id"), either(1, 3).alias("form"), either(2, 1).alias("company"), either(3, 2).cast("long").alias("cik"),
                      F.regexp_extract("id", r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"), F.try_to_timestamp("updated").alias("updated"))


def atom_items(spark: SparkSession, path: str) -> DataFrame:
    """News in Atom, in the columns of ``news_items``."""
    own = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href: string>, updated string, summary string").load(path)
    link = F.col("link._href")
    return own.select(F.substring(F.sha2(link, 256), 1, 16).alias("id"), "title", link.alias("link"), F.try_to_timestamp("updated").alias("published"), F.trim(F.regexp_replace("summary", "<[^>]*>", " ")).alias("summary"))


def newest_of_each(items: DataFrame, feed: str, limit: int) -> DataFrame:
    """The newest ``limit`` items of each feed."""
    return items.withColumn("_k", F.row_number().over(Window.partitionBy(feed).orderBy(F.desc("published"), "link"))).where(F.col("_k") <= limit).drop("_k")


def news_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items: id of the address, title, link, published, summary without markup."""
    own = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return own.select(F.substring(F.sha2("link", 256), 1, 16).alias("id"), "title", "link", when.alias("published"), F.trim(F.regexp_replace("description", "<[^>]*>", " ")).alias("summary"))
