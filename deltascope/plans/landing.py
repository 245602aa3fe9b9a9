"""Feeds and sinks end to end: rows of the tables are landed in a feed's format, read by its reader, and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import feeds, sinks
from ..sources.scratch import scratch
from ..sources.tables import read
from .base import registrar
from .roles import alerts, companies, filings, lines
from .temporal import PRICES, prices

QUERIES: dict = {}
query = registrar(QUERIES)

NUMBER = "lpad(CAST(cik AS VARCHAR), 10, '0') || '-' || strftime(filed, '%y') || '-' || lpad(CAST(accession AS VARCHAR), 6, '0')"


def _number():
    return F.concat_ws("-", F.lpad(F.col("cik").cast("string"), 10, "0"), F.date_format("filed", "yy"), F.lpad(F.col("accession").cast("string"), 6, "0"))


def _arrays(rows):
    """Rows of a company as the parallel arrays of a submissions feed."""
    text = lambda c: F.col(c).cast("string")
    one = F.struct(_number().alias("accessionNumber"), text("form").alias("form"), text("filed").alias("filingDate"), text("filed").alias("reportDate"), text("filed").alias("acceptanceDateTime"), F.concat(F.lit("xslF345X05/d"), text("accession"), F.lit(".xml")).alias("primaryDocument"),
                   F.lit("d").alias("primaryDocDescription"), F.lit("5.02,9.01").alias("items"), F.col("accession").alias("size"))
    own = rows.groupBy("cik").agg(F.collect_list(one).alias("r"))  # one company's filings
    return own.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.struct(*[F.col(f"r.{c}").alias(c) for c in feeds.RECENT]).alias("recent"))


def _land_feed(entries, key, root, path):
    """Entries (column ``value``) as XML files of up to a thousand ``key`` values each."""
    lots = entries.groupBy(F.expr(f"{key} div 1000").alias("lot")).agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"</{root}>")).alias("value"))
    lots.repartition("lot").write.partitionBy("lot").text(path)


RECENT = "struct<" + ", ".join(f"{c}: array<{'bigint' if c == 'size' else 'string'}>" for c in feeds.RECENT) + ">"


@query(f"SELECT cik, {NUMBER} AS accession, form, regexp_replace(form, '/A$', '') AS base_form, filed, 'd' || accession || '.xml' AS document, 2 AS n_items FROM filings")
def submissions_with_pages(spark, sf):
    """Submissions feeds with their newest three filings and a continuation page for the rest, read back as rows."""
    own = filings(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession"))))
    paths = []
    for name, rows in (("recent", own.where("k <= 3")), ("older", own.where("k > 3"))):
        paths.append(scratch(spark, f"submissions-{name}"))
        _arrays(rows).write.json(paths[-1])
    recent, older = (feeds.read_json(spark, p, f"cik string, recent {RECENT}") for p in paths)
    rows = feeds.all_submissions(recent, older, "recent", "recent")
    return rows.select("cik", "accession", "form", "base_form", "filed", "document", F.size("items").alias("n_items"))


@query("SELECT upper(replace(c_mktsegment, '.', '-')) || '-' || (c_custkey % 1000) AS ticker, lpad(CAST(min(c_custkey) AS VARCHAR), 10, '0') AS cik10, min(c_custkey) AS cik, min_by(c_name, c_custkey) AS name FROM customer GROUP BY 1", with_roles=False)
def ticker_directory(spark, sf):
    """The list of symbols, landed as JSON: one company a symbol, the smallest key wins."""
    path = scratch(spark, "tickers")
    read(spark, sf, "customer").select(F.col("c_custkey").alias("cik_str"), F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey") % 1000).alias("ticker"), F.col("c_name").alias("title")).write.json(path)
    return feeds.ticker_map(feeds.read_json(spark, path, "cik_str bigint, ticker string, title string"))


@query("SELECT cik, name, ticker, exchange FROM (SELECT c_custkey AS cik, c_name AS name, 'T' || (c_custkey % 500) AS ticker, CASE c_nationkey % 5 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' WHEN 2 THEN 'OTC' WHEN 3 THEN 'CBOE' END AS exchange FROM customer) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE exchange WHEN 'NYSE' THEN 1 WHEN 'Nasdaq' THEN 2 WHEN 'CBOE' THEN 3 WHEN 'OTC' THEN 4 ELSE 5 END, cik) = 1", with_roles=False)
def company_universe(spark, sf):
    """Companies once a symbol, by exchange."""
    place = F.col("c_nationkey") % 5
    exchange = F.when(place == 0, "NYSE").when(place == 1, "Nasdaq").when(place == 2, "OTC").when(place == 3, "CBOE")
    return feeds.universe(read(spark, sf, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.concat(F.lit("T"), F.col("c_custkey") % 500).alias("ticker"), exchange.alias("exchange")))


@query(f"SELECT {NUMBER} AS accession, f.cik, form, c.name AS company, CAST(filed AS TIMESTAMP) AS updated FROM filings f JOIN (SELECT cik AS k, name FROM companies) c ON c.k = f.cik")
def atom_filings(spark, sf):
    """Filing feeds in Atom with both grammars of titles."""
    path = scratch(spark, "atom")
    own = filings(spark, sf).join(companies(spark, sf).select("cik", "name"), "cik")
    cik = F.lpad(F.col("cik").cast("string"), 10, "0")
    title = F.when(F.col("accession") % 2 == 0, F.concat(F.col("form"), F.lit(" - "), F.col("name"), F.lit(" ("), cik, F.lit(") (Filer)"))).otherwise(F.concat(F.col("name"), F.lit(" ("), cik, F.lit(") ["), F.col("form"), F.lit("]")))
    entry = F.concat(F.lit("<entry><id>urn:"), _number(), F.lit("</id><title>"), title, F.lit("</title><updated>"), F.date_format("filed", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("</updated><summary>s</summary></entry>"))
    _land_feed(own.select("accession", entry.alias("value")), "accession", "feed", path)
    return feeds.feed_entries(spark, path).select("accession", "cik", "form", "company", F.col("updated").cast("timestamp_ntz").alias("updated"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'atom' ELSE 'rss' END AS feed, date_trunc('second', ts) AS published FROM events)
SELECT feed, 'http://x.example.org/' || event_id AS link, published, 'value of ' || event_id AS summary FROM e QUALIFY row_number() OVER (PARTITION BY feed ORDER BY published DESC, link) <= 200""", with_roles=False)
def news_feeds_limited(spark, sf):
    """News in RSS and in Atom as one table, the newest two hundred of each feed."""
    own = read(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    link = F.concat(F.lit("http://x.example.org/"), F.col("event_id"))
    text = F.concat(F.lit("&lt;b&gt;value of&lt;/b&gt; "), F.col("event_id"))
    rss = F.concat(F.lit("<item><title>T</title><link>"), link, F.lit("</link><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>"), text, F.lit("</description></item>"))
    atom = F.concat(F.lit("<entry><title>T</title><link href=\""), link, F.lit("\"/><updated>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>"), text, F.lit("</summary></entry>"))
    paths = scratch(spark, "rss"), scratch(spark, "news-atom")
    _land_feed(own.where("event_id % 3 <> 0").select("event_id", rss.alias("value")), "event_id", "channel", paths[0])
    _land_feed(own.where("event_id % 3 = 0").select("event_id", atom.alias("value")), "event_id", "feed", paths[1])
    both = feeds.news_items(spark, paths[0]).withColumn("feed", F.lit("rss")).unionByName(feeds.atom_items(spark, paths[1]).withColumn("feed", F.lit("atom")))
    newest = feeds.newest_of_each(both, "feed", 200)
    return newest.select("feed", "link", F.col("published").cast("timestamp_ntz").alias("published"), F.regexp_replace("summary", " +", " ").alias("summary"))


@query("SELECT f.cik, l.flag AS concept, CASE WHEN l.status = 'O' THEN 'USD' ELSE 'shares' END AS unit, f.filed AS ended, f.form, l.cents AS val FROM lines l JOIN filings f ON f.accession = l.accession")
def company_facts(spark, sf):
    """Company facts: nested by taxonomy, concept and unit in JSON, read back as rows."""
    path = scratch(spark, "facts")
    own = lines(spark, sf).join(filings(spark, sf), "accession").select("cik", "flag", F.when(F.col("status") == "O", "USD").otherwise("shares").alias("unit"), F.struct(F.col("filed").cast("string").alias("end"), F.col("cents").alias("val"), "form").alias("x"))
    units = own.groupBy("cik", "flag", "unit").agg(F.collect_list("x").alias("v")).groupBy("cik", "flag").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "v"))).alias("units")).alias("c"))  # one company's facts
    units.groupBy("cik").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("flag", "c"))).alias("us-gaap")).alias("facts")).write.json(path)
    kind = "cik bigint, facts map<string, map<string, struct<units: map<string, array<struct<`end`: string, val: bigint, form: string>>>>>>"
    return feeds.facts(feeds.read_json(spark, path, kind)).select("cik", "concept", "unit", "ended", "form", "val")


@query("SELECT doc_id, left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 2000) AS text FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') NOT IN ('', ' ')", with_roles=False)
def clipped_changes_csv(spark, sf):
    """Changes as CSV, their texts cut to 2,000 characters (the format's feature), read back; empty cells are left out."""
    path = scratch(spark, "changes-csv")
    sinks.write_csv(read(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text")), path, clip={"text": 2000})
    out = spark.read.csv(path, header=True, schema="doc_id bigint, text string", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return out.where("text is not null and text <> ' '")


@query("SELECT accession, ranking FROM alerts WHERE ranking >= 3")
def notifications_appended(spark, sf):
    """Notifications appended as JSON lines, one rank after another."""
    path = scratch(spark, "notifications")
    for rank in (3, 4, 5):
        sinks.append_json(alerts(spark, sf).where(F.col("ranking") == rank).select("accession", "ranking"), path)
    return spark.read.schema("accession bigint, ranking int").json(path)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL) GROUP BY 2", with_roles=False)
def documents_stored_once(spark, sf):
    """Fetched documents whose content is not stored yet, once each by hash."""
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", "lang", F.col("text").alias("content"))
    stored = docs.where("lang = 'de'").select(F.sha2("content", 256).alias("sha256"))
    return sinks.store_documents(docs.select("doc_id", "content"), stored).select("doc_id", "sha256")


@query("SELECT f.cik, count(*) AS n, max(f.filed) AS newest, CAST(sum(CASE WHEN f.form LIKE '%/A' THEN 1 ELSE 0 END) AS BIGINT) AS amendments FROM filings f GROUP BY f.cik")
def company_feeds_manifest(spark, sf):
    """A JSON feed for each company in ASCII, and the manifest that lists them."""
    path = scratch(spark, "company-feeds")
    entry = F.struct(F.col("accession"), F.col("form"), F.col("filed").cast("string").alias("filed"), F.lit("é").alias("mark"))
    feed = filings(spark, sf).groupBy("cik").agg(F.array_sort(F.collect_list(entry)).alias("filings"))  # one company's filings
    feed.select(sinks.ascii_json(F.struct("cik", "filings")).alias("value")).write.text(path)
    back = spark.read.schema("cik bigint, filings array<struct<accession: bigint, form: string, filed: date, mark: string>>").json(path)
    rows = back.select("cik", F.inline("filings")).where("mark = 'é'")
    return rows.groupBy("cik").agg(F.count("*").alias("n"), F.max("filed").alias("newest"), F.count_if(F.col("form").endswith("/A")).alias("amendments"))


@query(f"WITH {PRICES} SELECT ticker, day, close, volume FROM prices", with_roles=False)
def price_history(spark, sf):
    """Daily closes and volumes, landed as CSV and read with their types."""
    path = scratch(spark, "prices")
    prices(spark, sf).write.csv(path, header=True)
    return feeds.read_csv(spark, path, "ticker bigint, day date, close double, volume bigint", {"volume": 0})


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS key, CAST(sum(length(c_name) + length(CAST(c_custkey AS VARCHAR)) + 19) AS BIGINT) AS bytes, sha256(string_agg('{"cik":' || c_custkey || ',"name":"' || c_name || '"}' || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY 1""", with_roles=False)
def feed_files_manifest(spark, sf):
    """A feed file for each nation's companies and the manifest beside them, read back."""
    own = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"))
    return sinks.write_feeds(own, "nation", F.to_json(F.struct("cik", "name")), "cik", scratch(spark, "feed-files")).select("key", "bytes", "sha256")
