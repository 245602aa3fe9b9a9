"""Stored tables in folders by hash of their key, whose changes rewrite only the folders that they touch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str) -> None:
    (df.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))


def create(df: DataFrame, keys: Sequence[str], path: str, buckets: int = 64) -> None:
    """Store ``df`` below ``path`` in ``buckets`` folders. Null keys have a place like all others."""
    _write(df.withColumn("_bucket", _bucket(keys, buckets)), path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored rows; ``schema`` as of the table that was stored."""
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema])


def change(spark: SparkSession, path: str, schema, keys: Sequence[str], new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Change the stored table by ``how(old, new)``, one of the table changes by key (upsert, insert or ignore, replace, delete);
    returns the folders written.

    Only folders that hold a key of ``new`` are read. Their outcome is staged as a whole first; then the folders whose rows
    differ from the stored ones are put in place by a dynamic overwrite, all others keep their files. A job that dies while it
    stages changes nothing; one that dies while folders are put in place is run again with the same ``new``, since changes
    by key give the same rows twice. A rerun finds no difference and writes nothing.
    """
    own = new.withColumn("_bucket", _bucket(keys, buckets))
    touched = [r["_bucket"] for r in own.select("_bucket").distinct().collect()]  # at most one number a folder
    if not touched:
        return []
    names = [f.name for f in schema]
    stored = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).select(*names, F.col("_bucket").cast("int"))
    staged = scratch(spark, "staged")
    how(stored.select(*names), new).select(*names).withColumn("_bucket", _bucket(keys, buckets)).write.parquet(staged)
    after = spark.read.parquet(staged)
    mark = lambda df, c: df.groupBy("_bucket").agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("h")).alias(c))
    both = mark(stored, "a").join(mark(after, "b"), "_bucket", "full_outer")
    differ = sorted(r["_bucket"] for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket").collect())
    gone = sorted(r["_bucket"] for r in both.where("b is null").select("_bucket").collect())
    if differ:
        _write(after.where(F.col("_bucket").isin(differ)), path)
    for b in gone:  # folders whose last row went
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket={b}")
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    return differ
