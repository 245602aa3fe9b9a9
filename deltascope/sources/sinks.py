"""Writers: CSV, JSON lines, per-entity feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str) -> Column:
    """A flat CSV cell: lists joined by ", ", structures as JSON, nulls empty."""
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.coalesce(F.array_join(F.transform(name, lambda x: x.cast("string")), ", "), F.lit(""))
    if kind in ("struct", "map"):
        return F.coalesce(F.to_json(name), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, clip: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    """Flat CSV with a header; ``clip`` bounds the characters of a column."""
    out = []
    for c in columns or df.columns:
        x = cell(df, c)
        out.append((F.substring(x, 1, clip[c]) if clip and c in clip else x).alias(c))
    df.select(*out).write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def ascii_json(record: Column) -> Column:
    """JSON text in ASCII alone: other characters as \\u escapes."""
    units = F.transform(F.filter(F.split(F.to_json(record), ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.lpad(F.substring(F.hex(F.encode(c, "UTF-16BE")), 1, 4), 4, "0")), F.when(F.length(F.hex(F.encode(c, "UTF-16BE"))) > 4, F.concat(F.lit("\\u"), F.lower(F.substring(F.hex(F.encode(c, "UTF-16BE")), 5, 4)))).otherwise(""))))
    return F.array_join(units, "")


def store_documents(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Of fetched rows with a ``content``, those whose content is new, once each (the smallest row), with its SHA-256."""
    own = fetched.withColumn("sha256", F.sha2("content", 256)).join(stored.select("sha256").distinct(), "sha256", "left_anti")
    return own.groupBy("sha256").agg(F.min(F.struct(*fetched.columns)).alias("_row")).select("_row.*", "sha256")


def write_feeds(df: DataFrame, key: str, record: Column, order: str, path: str) -> DataFrame:
    """One text file of JSON lines for each ``key`` in the folder ``path``/feeds/key=..., its lines in ``order``, and beside them
    ``path``/manifest with a line a file: key, file, bytes, sha256. Returns the manifest as read back. Rows of one key make one
    file, as the feed's readers want it; null keys stand in a folder of their own."""
    own = df.select(F.col(key).alias("key"), record.alias("value"), F.col(order).alias("_order"))
    own.repartition("key").sortWithinPartitions("key", "_order").select("key", "value").write.mode("overwrite").partitionBy("key").text(f"{path}/feeds")
    manifest_of(df.sparkSession, f"{path}/feeds").write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema("key string, file string, bytes bigint, sha256 string").json(f"{path}/manifest")


def manifest_of(spark, path: str) -> DataFrame:
    """key, file, bytes and SHA-256 of every file in the folders key=... below ``path``, from the files themselves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "/key=([^/]*)/", 1).alias("key"), F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stale_files(spark, path: str, older_than_seconds: float) -> DataFrame:
    """Files below ``path`` by age: path, bytes, modified, stale; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.withColumn("stale", F.unix_micros(F.current_timestamp()) - F.unix_micros("modified") > F.lit(int(older_than_seconds * 1_000_000)))
