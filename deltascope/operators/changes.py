"""Changes of tables: upserts, inserts of new keys, replacements and set differences, each as a derived table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_empty: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` written over it by key. Columns in ``keep`` never change once a key exists, those
    in ``keep_if_empty`` not by a null or empty value; columns that ``new`` lacks stay. One full outer join."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_in_new"))
    o = old.withColumn("_in_old", F.lit(True))
    joined = o.join(n, list(keys), "full_outer")
    out = []
    for c in old.columns:
        if c in keys or c not in new.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(F.col("_in_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
        elif c in keep_if_empty:
            out.append(F.when(F.col("_in_new") & (F.coalesce(F.col(f"_new_{c}").cast("string"), F.lit("")) != ""), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_in_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys)))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` take the place of equal keys whole; columns that they lack become null."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All of a parent's old rows go, its new ones come."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").unionByName(new)


def retain(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``."""
    return rows.where(F.col(at) >= F.date_sub(as_of, days))


def json_set(document: Column, key: str, value: Column) -> Column:
    """The JSON object ``document`` with ``key`` set to the text ``value``; all other keys keep their values of any kind (in
    the order of their names). What is null or no JSON object becomes an object with this key alone; a null value is
    null in JSON."""
    others = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    own = F.variant_get(F.parse_json(F.to_json(F.struct(value.cast("string").alias("x")), {"ignoreNullFields": "false"})), "$.x", "variant")
    kept = F.map_filter(F.coalesce(others, F.create_map().cast("map<string,variant>")), lambda k, v: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), own)), {"ignoreNullFields": "false"})
