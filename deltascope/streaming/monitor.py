"""Feed monitors as Structured Streaming: each function takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_entries(entries: DataFrame, keys: list[str], at: str, keep: str = "1 day") -> DataFrame:
    """First sight of each key; keys are forgotten ``keep`` after their time, so the state stays bounded."""
    return entries.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)


def watched(entries: DataFrame, watchlist: DataFrame, key: str) -> DataFrame:
    """Entries on the watchlist; an empty watchlist lets all pass."""
    return entries if watchlist.isEmpty() else entries.join(watchlist.select(key).distinct(), key, "left_semi")


def unmuted(entries: DataFrame, mutes: DataFrame, key: str, at: str) -> DataFrame:
    """Entries whose key is not muted at their time; ``mutes`` is (key, muted_until)."""
    own = mutes.groupBy(F.col(key).alias("_k")).agg(F.max("muted_until").alias("_until"))
    return entries.join(own, F.col(key) == F.col("_k"), "left").where(F.col("_until").isNull() | (F.col(at) >= F.col("_until"))).drop("_k", "_until")


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and means a window and key; windows close ``late`` after their end."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(window, *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean")


def combine(filings: DataFrame, news: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Filings and news of a key within a time of each other become one alert with the wider gap."""
    f = filings.withWatermark("ts", within).alias("f")
    n = news.withWatermark("ts", within).alias("n")
    near = F.expr(f"n.{key} = f.{key} AND n.ts BETWEEN f.ts - INTERVAL {within} AND f.ts + INTERVAL {within}")
    return f.join(n, near).select(F.col(f"f.{key}"), F.col("f.ts"), F.greatest("f.gap", "n.gap").alias("gap"))


def throttled(alerts: DataFrame, key: str, at: str, hours: float = 6.0, late: str = "1 day") -> DataFrame:
    """Alerts let through by a throttle that counts from the last one sent. One time a key is kept as state, and only until
    the watermark (``late`` behind the newest time) has passed the throttle; times are sorted within a micro-batch."""
    import pandas as pd

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [], at: []})
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f[at])
        sent = []
        for t in times:
            if last is None or t.timestamp() - last >= hours * 3600:
                sent.append(t)
                last = t.timestamp()
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + hours * 3600) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(sent), at: sent})

    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    own = alerts.select(key, at).withWatermark(at, late)
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} {kinds[at]}", "last double", "append", "EventTimeTimeout")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "5 minutes", mode: str = "append") -> StreamingQuery:
    """Start a monitor; the checkpoint makes a restart go on after the last finished batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
