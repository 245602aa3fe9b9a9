"""Reports, searches and monitors' batch counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import temporal
from ..sources.tables import read
from ..streaming import monitor
from .base import registrar
from .roles import alerts, companies, filings, lines

QUERIES: dict = {}
query = registrar(QUERIES)


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '\\.example\\.(org|net)') AND (url ILIKE '%REF=%' OR html ILIKE '%rewh%') AND html ILIKE '%lang=\"en\"%' ORDER BY page_id LIMIT 100", with_roles=False)
def article_search(spark, sf):
    """Articles of some sources with a keyword in any of the columns and every language asked for."""
    own = read(spark, sf, "pages").where(F.col("url").rlike(r"\.example\.(org|net)"))
    return own.where(F.col("url").ilike("%REF=%") | F.col("html").ilike("%rewh%")).where(F.col("html").ilike('%lang="en"%')).orderBy("page_id").limit(100).select("page_id")


@query("SELECT cik, name FROM companies WHERE lower(name) LIKE '%00012%' OR lower(sector) LIKE '%asia%' AND lower(segment) LIKE '%build%' ORDER BY cik LIMIT 60")
def watchlist_search(spark, sf):
    any_of = F.col("name").ilike("%00012%") | (F.col("sector").ilike("%ASIA%") & F.col("segment").ilike("%build%"))
    return companies(spark, sf).where(any_of).orderBy("cik").limit(60).select("cik", "name")


@query("SELECT cik, segment, CASE segment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 99 END AS place FROM companies ORDER BY place, cik LIMIT 80")
def watchlist_by_priority(spark, sf):
    places = F.create_map(*[F.lit(x) for x in ("BUILDING", 0, "MACHINERY", 1, "FURNITURE", 2)])
    own = companies(spark, sf).withColumn("place", F.coalesce(F.try_element_at(places, F.col("segment")), F.lit(99)))
    return own.orderBy("place", "cik").limit(80).select("cik", "segment", "place")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, count(*) AS n FROM events GROUP BY 1", with_roles=False)
def section_activity_counts(spark, sf):
    """Counts of a value held in JSON text."""
    return read(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("item")).agg(F.count("*").alias("n"))


@query("""SELECT form, count(*) AS n_total, count(*) FILTER (WHERE materiality >= 60) AS n_material, round(count(*) FILTER (WHERE materiality >= 60) / count(*)::DOUBLE, 4) AS rate FROM alerts GROUP BY form""")
def batch_materiality_report(spark, sf):
    material = F.count_if(F.col("materiality") >= 60)
    return alerts(spark, sf).groupBy("form").agg(F.count("*").alias("n_total"), material.alias("n_material"), F.round(material / F.count("*"), 4).alias("rate"))


@query("""WITH e AS (SELECT accession, cik % 50 AS ticker, TIMESTAMP '2024-01-03' + to_days(CAST(accession % 25 AS INTEGER)) AS at FROM filings WHERE form = '8-K'),
h AS (SELECT e.accession, max(CASE WHEN v.value >= 60 THEN 1 ELSE 0 END) AS hit FROM e JOIN events v ON v.user_id % 50 = e.ticker AND v.ts >= e.at - INTERVAL 2 DAY AND v.ts < e.at GROUP BY e.accession)
SELECT count(*) AS events, CAST(coalesce(sum(h.hit), 0) AS BIGINT) AS with_precursor, round(coalesce(sum(h.hit), 0) / count(*)::DOUBLE, 6) AS recall FROM e LEFT JOIN h ON h.accession = e.accession""")
def precursor_backtest(spark, sf):
    """Share of events that a strong article precedes by at most two days."""
    e = filings(spark, sf).where("form = '8-K'").select("accession", (F.col("cik") % 50).alias("ticker"), F.expr("timestamp'2024-01-03' + make_interval(0, 0, 0, cast(accession % 25 as int))").alias("at"))
    v = read(spark, sf, "events").where("value >= 60").select((F.col("user_id") % 50).alias("ticker"), "ts")
    newest = temporal.asof_backward(e, v.select("ticker", F.col("ts").alias("at"), F.col("ts").alias("last")), ["ticker"], "at", ["last"], strict=True)
    near = newest.withColumn("hit", F.when(F.col("last") >= F.col("at") - F.expr("INTERVAL 2 DAYS"), 1))
    return near.agg(F.count("*").alias("events"), F.count("hit").alias("with_precursor"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY gap DESC, materiality DESC, accession) AS k FROM (SELECT * FROM alerts ORDER BY gap DESC, materiality DESC, accession LIMIT 10))
SELECT k AS position, printf('%d. filing %d (%s): gap %.2f', CAST(k AS INTEGER), accession, form, gap) AS line FROM t""")
def daily_digest(spark, sf):
    """The ten widest gaps as lines of text."""
    top = alerts(spark, sf).orderBy(F.desc("gap"), F.desc("materiality"), "accession").limit(10)
    own = top.withColumn("position", F.row_number().over(W.orderBy(F.desc("gap"), F.desc("materiality"), "accession")).cast("long"))  # ten rows
    return own.select("position", F.format_string("%d. filing %d (%s): gap %.2f", "position", "accession", "form", "gap").alias("line"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part", with_roles=False)
def slugs(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


@query("""WITH m AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-10' + to_days(CAST(c_custkey % 15 AS INTEGER)) AS until FROM customer)
SELECT e.event_id FROM events e LEFT JOIN m ON m.user_id = e.user_id WHERE m.until IS NULL OR e.ts >= m.until""", with_roles=False)
def unmuted_events(spark, sf):
    """Entries outside of their key's mute window."""
    mutes = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.expr("timestamp_ntz'2024-01-10' + make_interval(0, 0, 0, cast(c_custkey % 15 as int))").alias("muted_until"))
    return monitor.unmuted(read(spark, sf, "events"), mutes, "user_id", "ts").select("event_id")


@query("""SELECT f.event_id AS filing, n.event_id AS news, greatest(f.value, n.value) AS gap FROM events f JOIN events n ON f.user_id = n.user_id AND n.ts BETWEEN f.ts - INTERVAL 1 HOUR AND f.ts + INTERVAL 1 HOUR WHERE f.event_type = 'purchase' AND n.event_type = 'view'""", with_roles=False)
def combined_alerts(spark, sf):
    """Filings and news of a key within an hour of each other become one alert with the wider gap; an equi-join on hours."""
    own = read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    f = own.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("filing"), F.col("t").alias("ft"), F.col("value").alias("fv"), F.explode(F.sequence(F.floor((F.col("t") - hour) / hour), F.floor((F.col("t") + hour) / hour))).alias("h"))
    n = own.where("event_type = 'view'").select("user_id", F.col("event_id").alias("news"), F.col("t").alias("nt"), F.col("value").alias("nv"), F.floor(F.col("t") / hour).alias("h"))
    return f.join(n, ["user_id", "h"]).where(F.abs(F.col("nt") - F.col("ft")) <= hour).select("filing", "news", F.greatest("fv", "nv").alias("gap"))


@query("SELECT cik, count(*) AS n_new, count(*) FILTER (WHERE form LIKE '%/A') AS n_amendments, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents FROM filings GROUP BY cik")
def crawl_totals(spark, sf):
    return filings(spark, sf).groupBy("cik").agg(F.count("*").alias("n_new"), F.count_if(F.col("form").endswith("/A")).alias("n_amendments"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))


@query("SELECT accession, CASE WHEN ranking >= 3 THEN 2 WHEN gap > 45 THEN 2 WHEN gap > 25 THEN 1 ELSE 0 END AS tier, CASE WHEN materiality >= 50 AND burial >= 50 THEN 'buried' WHEN materiality >= 50 THEN 'open' ELSE 'routine' END AS kind FROM alerts")
def alert_tiers(spark, sf):
    a = alerts(spark, sf)
    tier = F.when(F.col("ranking") >= 3, 2).otherwise(scores.steps(F.col("gap") - 1e-9, ((45, 2), (25, 1)), 0))
    return a.select("accession", tier.alias("tier"), F.when((F.col("materiality") >= 50) & (F.col("burial") >= 50), "buried").when(F.col("materiality") >= 50, "open").otherwise("routine").alias("kind"))


@query("SELECT l.accession, l.seq, CAST(l.source AS VARCHAR) AS source FROM lines l JOIN filings f ON f.accession = l.accession WHERE l.shipped BETWEEN f.filed AND f.filed + 14")
def near_event_lines(spark, sf):
    own = lines(spark, sf).join(filings(spark, sf).select("accession", "filed"), "accession").where(F.col("shipped").between(F.col("filed"), F.date_add("filed", 14)))
    return own.select("accession", "seq", F.col("source").cast("string").alias("source"))


#: Questions to queries: the first pattern found decides. (pattern, forms, days back or None, rows)
ROUTES = ((r"insider|form 4", ("4",), 365, 50), (r"8-?k|event", ("8-K",), 365, 50), (r"annual|10-?k", ("10-K", "10-K/A"), None, 20), (r"quarter|10-?q", ("10-Q",), None, 20), (r"amend|late", ("10-K/A",), 730, 20), (r"latest|recent", None, None, 5))


def answer(spark, sf: str, question: str, cik: int) -> DataFrame:
    """Filings that a question about a company asks for; days count back from its newest filing."""
    own = filings(spark, sf).where(F.col("cik") == cik)
    forms, days, rows = next(((f, d, n) for p, f, d, n in ROUTES if re.search(p, question, re.I)), (None, None, 10))
    if forms:
        own = own.where(F.col("form").isin(*forms))
    if days:
        own = own.withColumn("_last", F.max("filed").over(W.partitionBy("cik"))).where(F.datediff("_last", "filed") <= days).drop("_last")
    return own.orderBy(F.desc("filed"), F.desc("accession")).limit(rows).select("accession", "form", "filed")


@query("SELECT accession, form, filed FROM filings WHERE cik = 10 AND form = '10-Q' ORDER BY filed DESC, accession DESC LIMIT 20")
def question_router(spark, sf):
    """The answer to one question."""
    return answer(spark, sf, "What did the last quarterly reports say?", 10)


#: One question for each branch, and one for none.
QUESTIONS = ("Any insider trades?", "Which events were there?", "Show the annual report", "The last quarterly reports", "Were there amendments?", "The most recent ones", "Anything else?")


@query(" UNION ALL ".join(f"(SELECT {i} AS question, accession, filed FROM filings WHERE cik = 10{c} ORDER BY filed DESC, accession DESC LIMIT {n})" for i, (c, n) in enumerate((
    (" AND form = '4' AND (SELECT max(filed) FROM filings WHERE cik = 10 AND form = '4') - filed <= 365", 50), (" AND form = '8-K' AND (SELECT max(filed) FROM filings WHERE cik = 10 AND form = '8-K') - filed <= 365", 50), (" AND form IN ('10-K', '10-K/A')", 20), (" AND form = '10-Q'", 20),
    (" AND form = '10-K/A' AND (SELECT max(filed) FROM filings WHERE cik = 10 AND form = '10-K/A') - filed <= 730", 20), ("", 5), ("", 10)))))
def question_branches(spark, sf):
    """The answers of every branch, question by question."""
    rows = [answer(spark, sf, q, 10).select(F.lit(i).alias("question"), "accession", "filed") for i, q in enumerate(QUESTIONS)]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
