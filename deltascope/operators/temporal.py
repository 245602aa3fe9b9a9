"""As-of joins, interval joins and sequential folds over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its keys at or (``strict``) before its time.

    One union and one window, so a key is shuffled once and sorted, never joined row by row. Rights of equal time: the
    largest values win. Left rows without a match get nulls.
    """
    own = [c for c in left.columns]
    l = left.select(F.struct(*own).alias("_l"), *by, F.col(at).alias("_at"), F.lit(None).alias("_r"), F.lit(0 if strict else 1).alias("_o"))
    kind = right.select(F.struct(*values).alias("s")).schema["s"].dataType
    r = right.select(F.lit(None).cast(left.select(F.struct(*own).alias("s")).schema["s"].dataType).alias("_l"), *by, F.col(at).alias("_at"), F.struct(*values).alias("_r"), F.lit(1 if strict else 0).alias("_o"))
    l = l.withColumn("_r", F.col("_r").cast(kind))
    w = Window.partitionBy(*by).orderBy("_at", "_o", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("_found", F.last("_r", ignorenulls=True).over(w))
    return both.where("_l is not null").select("_l.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with ``values`` of the first right row of its keys at or after its time. Rights of equal time: the smallest
    values win. Rows are read from the last time to the first, so that the window only grows; one that shrinks is counted
    anew for every row."""
    own = [c for c in left.columns]
    kind = right.select(F.struct(*values).alias("s")).schema["s"].dataType
    l = left.select(F.struct(*own).alias("_l"), *by, F.col(at).alias("_at"), F.lit(None).cast(kind).alias("_r"), F.lit(0).alias("_o"))
    r = right.select(F.lit(None).cast(left.select(F.struct(*own).alias("s")).schema["s"].dataType).alias("_l"), *by, F.col(at).alias("_at"), F.struct(*values).alias("_r"), F.lit(1).alias("_o"))
    w = Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_o"), F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("_found", F.last("_r", ignorenulls=True).over(w))
    return both.where("_l is not null").select("_l.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, before_days: int, after_days: int) -> DataFrame:
    """Pairs of equal keys with right time in [left - before, left + after) days, by day buckets: each left row looks
    into the buckets its interval covers, so the join stays an equi-join however long a key's history is."""
    width = max(1, before_days + after_days)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    l = left.withColumn("_b", F.explode(F.sequence(bucket(F.date_sub(F.to_date(left_at), before_days)), bucket(F.date_add(F.to_date(left_at), after_days)))))
    r = right.withColumn("_b", bucket(F.to_date(right_at)))
    low, high = F.col(left_at) - F.expr(f"INTERVAL {before_days} DAYS"), F.col(left_at) + F.expr(f"INTERVAL {after_days} DAYS")
    return l.join(r, [*by, "_b"]).where((F.col(right_at) >= low) & (F.col(right_at) < high)).drop("_b")


def asof_last_k(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], at: str, values: Sequence[str], k: int, within: str | None = None, tie: str | None = None) -> DataFrame:
    """Each left row (unique ``key``) with ``values`` of the newest ``k`` right rows of its keys strictly before its time, one row
    each, newest first (``place`` from 1); ``within`` (an interval) leaves out older ones, ``tie`` orders rights of equal
    time. Left rows without any are not in the result.

    Rights are numbered in order of time; a left row knows the number of the last one before it and asks for the k numbers
    up to it by an equi-join: at most k rows a left row, however many rights lie within the time. Numbers are counted in
    two levels, days and times of a day, so that the history of one key is not ordered in one task.
    """
    day = F.to_date(F.col(at))
    order = [F.col("_at"), F.col("_o"), *([F.col("_tie")] if tie else [])]
    l = left.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), day.alias("_day"), F.lit(0).alias("_o"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), F.col(key).alias("_key"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_v"))
    r = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), day.alias("_day"), F.lit(1).alias("_o"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"), F.lit(None).cast(left.schema[key].dataType).alias("_key"), F.struct(*values).alias("_v"))
    both = l.unionByName(r)
    days = both.groupBy(*by, "_day").agg(F.sum("_o").alias("_n"))
    days = days.select(*by, "_day", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_day")) - F.col("_n")).alias("_before"))
    # lefts of a time stand before rights of that time
    upto = Window.partitionBy(*by, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = both.withColumn("_c", F.sum("_o").over(upto)).join(days, [*by, "_day"]).withColumn("_c", F.col("_c") + F.col("_before"))
    rights = numbered.where("_o = 1").select(*by, F.col("_c").alias("_want"), F.col("_at").alias("_rat"), "_v")
    asked = numbered.where("_o = 0 and _c > 0").select(*by, "_key", "_at", "_c", F.explode(F.sequence("_c", F.greatest(F.col("_c") - k + 1, F.lit(1)))).alias("_want"))
    found = asked.join(rights, [*by, "_want"])
    if within is not None:
        found = found.where(F.col("_rat") >= F.col("_at") - F.expr(f"INTERVAL {within}"))
    return found.select(F.col("_key").alias(key), (F.col("_c") - F.col("_want") + 1).cast("int").alias("place"), *[F.col(f"_v.{v}").alias(v) for v in values])


def numbered_of(rows: DataFrame, of: str, order: Sequence[str], name: str, first: int = 2) -> DataFrame:
    """``rows`` with ``name``: their number within ``of`` from ``first``, in ``order``. Rows of no group (null) are each the first
    of their own and never meet in one task."""
    own = rows.where(F.col(of).isNotNull())
    own = own.withColumn(name, (F.row_number().over(Window.partitionBy(of).orderBy(*order)) + (first - 1)).cast("long"))
    return own.unionByName(rows.where(F.col(of).isNull()).withColumn(name, F.lit(first).cast("long")))


def throttled_counts(rows: DataFrame, by: str, at: str, gap: float) -> DataFrame:
    """(by, sent): how many rows of each key a throttle lets through that sends nothing within ``gap`` seconds of the last one
    sent. A task reads its keys' rows in order of time and keeps the last time sent of one key: no key's history is ever held
    as a whole. Null keys and times drop out."""
    import numpy as np
    import pandas as pd

    schema = rows.select(F.col(by)).schema
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    own = rows.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by), micros.alias("t")).repartition(by).sortWithinPartitions(by, "t")
    step = int(gap * 1_000_000)

    def run(batches):
        key = last = None
        sent = 0
        for b in batches:
            names, times = b[by].to_numpy(), b["t"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            for a, z in zip(cut, [*cut[1:], len(names)]):
                if key is None or names[a] != key:
                    if key is not None:
                        yield pd.DataFrame({by: [key], "sent": [sent]})
                    key, last, sent = names[a], None, 0
                t = times[a:z]
                i = 0 if last is None else int(np.searchsorted(t, last + step))
                while i < len(t):  # a binary search from one time sent to the next
                    last, sent = int(t[i]), sent + 1
                    i = int(np.searchsorted(t, last + step))
        if key is not None:
            yield pd.DataFrame({by: [key], "sent": [sent]})

    return own.mapInPandas(run, f"{by} {schema[by].dataType.simpleString()}, sent long")


def throttle(times: Column, gap: float, count: bool = False) -> Column:
    """Of a sorted array of numbers, those kept when nothing is sent within ``gap`` of the last one sent; ``count``: how many.
    The fold keeps the last time sent (and the number) alone, so a step costs the same however long the array is."""
    nothing = F.lit(None).cast("double")
    if count:
        start = F.struct(nothing.alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(times, start, lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= gap), F.struct(t.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc))["n"]
    start = F.struct(nothing.alias("last"), F.array().cast("array<double>").alias("kept"))
    return F.aggregate(times, start, lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= gap), F.struct(t.alias("last"), F.array_append(acc["kept"], t).alias("kept"))).otherwise(acc))["kept"]


def sliding_log(rows: DataFrame, key: str, by: str, at: str, calls: int, seconds: float) -> DataFrame:
    """(key, allowed) of every row with entity and time: a call is let through if fewer than ``calls`` calls of its entity were
    let through within the last ``seconds``; refused calls do not count. Calls of equal time go in order of ``key``. A task
    reads its entities in order of time and keeps the last ``calls`` times let through of one of them."""
    from collections import deque

    import pandas as pd

    own = rows.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), key)
    own = own.repartition("_by").sortWithinPartitions("_by", "_t", key)
    span = int(seconds * 1_000_000)

    def run(batches):
        entity, passed = object(), deque(maxlen=calls)
        for b in batches:
            out = []
            for e, t in zip(b["_by"].tolist(), b["_t"].tolist()):
                if e != entity:
                    entity, passed = e, deque(maxlen=calls)
                fine = len(passed) < calls or t - passed[0] >= span
                if fine:
                    passed.append(t)
                out.append(fine)
            yield pd.DataFrame({key: b[key], "allowed": out})

    return own.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, allowed boolean")
