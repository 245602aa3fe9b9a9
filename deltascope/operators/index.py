"""A keyword index of texts: postings of their white-space-delimited chunks, in folders by hash of the chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(texts: DataFrame, key: str, path: str, buckets: int = 64, lot: int = 100_000) -> None:
    """Index ``texts`` (``key``, text) below ``path``: ``words`` (chunk, bucket) and ``postings`` (bucket, chunk, keys).

    A posting holds at most the keys of one of the lots that all keys are dealt into by hash, about ``lot`` texts each, so that
    the commonest word is many rows and not one. Null texts and keys are left out."""
    own = texts.where(F.col(key).isNotNull() & F.col("text").isNotNull())
    lots = 1 + own.count() // lot
    chunks = own.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("chunk")).where("chunk <> ''")
    bucket = F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int")
    rows = chunks.groupBy("chunk", F.pmod(F.xxhash64("key"), F.lit(lots)).alias("lot")).agg(F.collect_list("key").alias("keys")).select(bucket.alias("bucket"), "chunk", "keys")
    rows.repartition("bucket", F.pmod(F.xxhash64("chunk", F.lit(1)), F.lit(lots))).sortWithinPartitions("bucket", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = texts.sparkSession
    spark.read.parquet(f"{path}/postings").select("chunk", "bucket").distinct().write.mode("overwrite").parquet(f"{path}/words")


def _postings(spark: SparkSession, path: str, like) -> DataFrame:
    """(key) of the texts with a chunk that meets ``like``: the word list says which folders to read."""
    words = spark.read.parquet(f"{path}/words").where(like(F.col("chunk")))
    needed = [r["bucket"] for r in words.select("bucket").distinct().collect()]  # at most one number a folder
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(needed) & like(F.col("chunk")))
    return found.select(F.explode("keys").alias("key")).distinct()


def containing(texts: DataFrame, key: str, path: str, keyword: str) -> DataFrame:
    """(key) of the texts that contain ``keyword`` anywhere, whatever its case: the rows that a scan of all texts would find.

    Text within one chunk is found in the word list; a keyword of several words is looked up word by word (the first ends
    a chunk, the last begins one), and the texts in which all are found are compared with the whole keyword. A blank
    keyword is compared with every text. Nothing is found for a keyword of no characters but in texts that are there."""
    spark, low = texts.sparkSession, keyword.lower()
    pieces = low.split()
    whole = F.contains(F.lower("text"), F.lit(low))
    if not pieces:
        return texts.where(F.col(key).isNotNull() & whole).select(F.col(key).alias("key")).distinct()
    if [low] == pieces:
        return _postings(spark, path, lambda c: F.contains(c, F.lit(low)))
    first, last = low[0].isspace(), low[-1].isspace()
    found = None
    for k, piece in enumerate(pieces):
        open_left, open_right = k == 0 and not first, k == len(pieces) - 1 and not last
        if open_left and open_right:
            like = lambda c, p=piece: F.contains(c, F.lit(p))
        elif open_left:
            like = lambda c, p=piece: F.endswith(c, F.lit(p))
        elif open_right:
            like = lambda c, p=piece: F.startswith(c, F.lit(p))
        else:
            like = lambda c, p=piece: c == p
        own = _postings(spark, path, like)
        found = own if found is None else found.join(own, "key", "left_semi")
    return texts.withColumnRenamed(key, "key").join(found, "key", "left_semi").where(whole).select("key").distinct()
