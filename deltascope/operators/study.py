"""Event studies: a market model and cumulative abnormal returns for every event's own date, from running sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_backward

#: A day before all others: its row holds the sums of no days.
START = "date'0001-01-01'"


def running_sums(daily: DataFrame, by: str, day: str, y: str, x: str, ahead: Sequence[int]) -> DataFrame:
    """One row a day of ``by`` (and one before all days) with the count and the sums of x, y, xy and x² up to that day, and
    the day and the sums of x and y ``ahead`` trading days later. Days without both values are no common days."""
    w = Window.partitionBy(by).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = daily.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, day, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1).alias("one"))
    first = common.select(by).distinct().select(by, F.expr(START).alias(day), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("one"))
    total = lambda c: F.sum(c).over(upto)
    sums = common.unionByName(first).select(by, day, total("one").alias("n"), total("x").alias("sx"), total("y").alias("sy"), total(F.col("x") * F.col("y")).alias("sxy"), total(F.col("x") * F.col("x")).alias("sxx"))
    later = [F.lead(F.struct(F.col(day).alias("day"), "n", "sx", "sy"), k).over(w).alias(f"ahead{k}") for k in ahead]
    return sums.select("*", *later)


def market_model(events: DataFrame, daily: DataFrame, key: str, by: str, at: str, day: str = "day", y: str = "ret", x: str = "bench", windows: Mapping[str, int] = {"car3": 3},
                 estimation: tuple[int, int] = (170, 10), least: int = 20, slack: int = 5, flat: float = 1e-10, salts: int = 8) -> DataFrame:
    """``events`` (unique ``key``, entity ``by``, date ``at``) with days, beta, alpha and a cumulative abnormal return for each of
    ``windows`` (name -> last day after the event).

    The model is fitted by least squares over the common days from ``estimation[0]`` to ``estimation[1]`` days before the
    event (beta 1 where the benchmark hardly moves); events with fewer than ``least`` such days, or no common day in the
    first window, drop out. A return sums the first last + 1 common days from the event on, no later than last + ``slack``
    days after it; without any it is null. Null dates and entities drop out.

    No event meets the days of its window: running sums of each entity are looked up by one as-of pass at the ends of the
    windows and subtracted, so the work is events + days, however long the windows. Events of one entity are dealt over
    ``salts`` copies of its daily sums. Sums are doubles; a difference of sums loses about as many digits as the sum over
    all days is larger than that over a window.
    """
    steps = sorted({last + 1 for last in windows.values()})
    sums = running_sums(daily, by, day, y, x, steps)
    fields = [c for c in sums.columns if c not in (by, day)]
    spread = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    named = events.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(F.col(key).alias("_key"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt"))
    ends = {"a": -estimation[0] - 1, "b": -estimation[1], "c": -1} | {name: last + slack for name, last in windows.items()}
    probes = named.select("_key", "_at", F.col("_by").alias(by), "_salt", F.explode(F.array(*[F.struct(F.lit(name).alias("end"), F.date_add("_at", offset).alias(day)) for name, offset in ends.items()])).alias("p"))
    probes = probes.select("_key", "_at", by, "_salt", "p.end", F.col(f"p.{day}").alias(day))
    right = spread.select(by, "_salt", day, F.struct(*fields).alias("s"))
    found = asof_backward(probes, right, [by, "_salt"], day, ["s"])
    one = lambda name: F.max(F.when(F.col("end") == name, F.col("s"))).alias(name)  # noqa: E731  # one row of each end
    e = found.groupBy("_key", "_at").agg(*[one(name) for name in ends])
    d = lambda f: F.col(f"b.{f}") - F.col(f"a.{f}")
    n = d("n")
    sx, sy = d("sx"), d("sy")
    var, cov = d("sxx") - sx * sx / n, d("sxy") - sx * sy / n
    e = e.where(n >= least).withColumn("days", n).withColumn("beta", F.when(var > flat, cov / var).otherwise(1.0))
    e = e.withColumn("alpha", (sy - F.col("beta") * sx) / n)
    for name, last in windows.items():
        full, short, before = F.col(f"c.ahead{last + 1}"), F.col(name), F.col("c")
        whole = F.coalesce(full["day"] <= F.date_add(F.col("_at"), last + slack), F.lit(False))
        end = lambda f: F.when(whole, full[f]).otherwise(short[f]) - before[f]
        abnormal = end("sy") - F.col("alpha") * end("n") - F.col("beta") * end("sx")
        e = e.withColumn(f"={name}", F.when(end("n") > 0, abnormal))
    first = next(iter(windows))
    return e.where(F.col(f"={first}").isNotNull()).select(F.col("_key").alias(key), "days", "beta", "alpha", *[F.col(f"={name}").alias(name) for name in windows])


def summary(cars: DataFrame, by: str, main: str, others: Sequence[str]) -> DataFrame:
    """Events, mean returns and hit rate of each group: windows whose return is missing or exactly zero count as ``main``."""
    own = cars.select(by, main, *[F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(main)).alias(c) for c in others])
    return own.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in (main, *others)], F.avg(F.when(F.col(main) > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
