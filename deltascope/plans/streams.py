"""Monitors run over the ``events`` files with ``availableNow``; their results equal the batch queries of the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment
from ..sources import sinks
from ..sources.scratch import scratch
from ..sources.tables import read
from ..streaming import keyed, monitor
from .base import registrar
from .roles import alerts
from .temporal import QUERIES as TEMPORAL

QUERIES: dict = {}
query = registrar(QUERIES)


def events_stream(spark, sf):
    """The events table as a stream of files."""
    schema = read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(spark, stream, mode, schema):
    """Run to the end of what is there and read the sink back. Each batch has a folder of its own, written over if the batch
    is run again after a failure, so that no row comes twice."""
    out = scratch(spark, "stream-out")

    def sink(batch, i):
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={i}")

    keyed.started(spark, lambda: monitor.run(stream, sink, scratch(spark, "stream-state"), once=True, mode=mode)).awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*[c.strip().split(" ")[0] for c in schema.split(",")])


@query(TEMPORAL["throttled_alerts"][1], with_roles=False)
def stream_throttled_alerts(spark, sf):
    """The six-hour throttle as a stateful stream."""
    sent = monitor.throttled(events_stream(spark, sf).where("event_type = 'view'"), "user_id", "ts")
    return _finish(spark, sent, "append", "user_id long, ts timestamp").groupBy("user_id").agg(F.count("*").alias("sent"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(CAST(round(value * 100) AS BIGINT)) / 100, 6) AS mean FROM events GROUP BY 1, 2", with_roles=False)
def stream_tumbling_counts(spark, sf):
    """Extension: one-day windows with a watermark."""
    cents = events_stream(spark, sf).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = monitor.tumbling(cents, "ts", "1 day", ["event_type"])
    return _finish(spark, out, "complete", "start timestamp, event_type string, n long, mean double").withColumn("mean", F.round(F.col("mean") / 100, 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2", with_roles=False)
def stream_deduplicated(spark, sf):
    """Entries seen once by id, on a watchlist of all users."""
    own = events_stream(spark, sf)
    fresh = monitor.new_entries(own, ["event_id"], "ts", "40 days").select("event_id", "user_id", "event_type")
    return _finish(spark, fresh, "append", "event_id long, user_id long, event_type string").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT f.user_id, count(*) AS n, round(sum(CAST(round(greatest(f.value, n.value) * 100) AS BIGINT)) / 100, 2) AS gap FROM events f JOIN events n ON n.user_id = f.user_id AND n.event_type = 'click' AND n.ts BETWEEN f.ts - INTERVAL 1 HOUR AND f.ts + INTERVAL 1 HOUR
WHERE f.event_type = 'view' GROUP BY f.user_id""", with_roles=False)
def stream_combined_alerts(spark, sf):
    """Two streams joined within an hour: filings and news of a key become one alert with the wider gap."""
    own = events_stream(spark, sf).select("user_id", "ts", "event_type", F.col("value").alias("gap"))
    both = monitor.combine(own.where("event_type = 'view'"), own.where("event_type = 'click'"), "user_id")
    out = _finish(spark, both, "append", "user_id long, ts timestamp, gap double")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("gap") * 100).cast("long")) / 100, 2).alias("gap"))


@query("SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2", with_roles=False)
def stream_newest_ids(spark, sf):
    """Each kind of event as a feed of users, deduplicated by its newest 100,000 ids; the SQL says the same while a feed has no
    more users than that."""
    own = events_stream(spark, sf).select("event_type", "user_id", "ts")
    fresh = keyed.newest_ids(own, "event_type", "user_id", "ts", 100_000)
    return _finish(spark, fresh, "append", "event_type string, user_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH RECURSIVE o AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
k AS (SELECT user_id, min(ts) AS ts FROM o GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(o.ts) FROM o WHERE o.user_id = k.user_id AND o.ts >= k.ts + INTERVAL 6 HOUR) FROM k WHERE k.ts IS NOT NULL)
SELECT user_id, ts FROM k WHERE ts IS NOT NULL""", with_roles=False)
def stream_throttle_timers(spark, sf):
    """Purchases at least six hours after the last one sent; timers clear the times that can hold nothing back."""
    own = events_stream(spark, sf).where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    sent = keyed.throttled(own, "user_id", "ts", ["event_id"])
    return _finish(spark, sent, "append", "user_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id IS NOT NULL AND v.ts IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts <= v.ts AND v.ts < p.ts + INTERVAL 12 HOUR)""", with_roles=False)
def stream_changing_mutes(spark, sf):
    """Views outside of their user's mute, which each purchase sets anew for twelve hours while the stream runs."""
    own = events_stream(spark, sf)
    mutes = own.where("event_type = 'purchase'").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    heard = keyed.muted_by(own.where("event_type = 'view'").select("user_id", "ts", "event_id"), mutes, "user_id", "ts", "until", ["event_id"])
    return _finish(spark, heard.select("event_id"), "append", "event_id long")


@query("SELECT accession, form, gap FROM alerts WHERE ranking >= 3")
def alerts_csv_roundtrip(spark, sf):
    """Alerts written as CSV and read back."""
    path = scratch(spark, "alerts-csv")
    sinks.write_csv(alerts(spark, sf).where("ranking >= 3"), path, ["accession", "form", "gap"])
    return spark.read.csv(path, header=True, schema="accession long, form string, gap double")


@query("SELECT accession, form, gap FROM alerts WHERE ranking >= 3")
def alerts_json_feed_roundtrip(spark, sf):
    """Alerts written as JSON feeds by form and read back."""
    path = scratch(spark, "alerts-json")
    sinks.write_json(alerts(spark, sf).where("ranking >= 3").select("accession", "form", "gap"), path, by=["form"])
    return spark.read.schema("accession long, gap double, form string").json(path)


@query(None)
def page_article_text(spark, sf):
    """Body of each article page by its element, whole page if short."""
    return segment.page_texts(read(spark, sf, "pages"), "page_id", segment.article_body)


@query(None)
def page_block_text(spark, sf):
    """Pages as lines of blocks."""
    return segment.page_texts(read(spark, sf, "pages"), "page_id", segment.html_to_text)
