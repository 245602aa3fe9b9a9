"""Scores and rankings, the flagship among them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.tables import read
from .base import registrar
from .roles import alerts, companies, filings, lines

QUERIES: dict = {}
query = registrar(QUERIES)

# Sector profiles (cost of capital, critical, high and mean gap).
PROFILES = {"AMERICA": (0.095, 70, 50, 0.42), "ASIA": (0.085, 65, 45, 0.35), "EUROPE": (0.080, 60, 40, 0.38), "AFRICA": (0.090, 68, 48, 0.40), "MIDDLE EAST": (0.088, 55, 35, 0.45)}
PROFILE_SQL = "profiles AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}, {c}, {d}::DOUBLE)" for k, (a, b, c, d) in PROFILES.items()) + ") AS t(sector, wacc, critical, high, mean_gap))"

BASE = """base AS (SELECT f.cik, CAST(sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS materiality, least(1.0, sum(tax) / 10.0::DOUBLE / count(*)) AS quality, count(*) AS n FROM lines l JOIN filings f ON f.accession = l.accession GROUP BY f.cik),
comp AS (SELECT *, 0.35 * least(n / 20.0::DOUBLE, 1.0) + 0.65 * quality AS composite FROM base), g AS (SELECT *, materiality / greatest(composite, 0.01) AS gap FROM comp),
u AS (SELECT cik, n, gap, round(least(greatest(least(gap * 100, 100.0) + CASE WHEN n < 5 THEN 10.0 ELSE 0.0 END - CASE WHEN materiality < 0.2 THEN 15.0 ELSE 0.0 END, 0.0), 100.0), 2) AS score,
  round(sqrt(least(n / 20.0::DOUBLE, 1.0)) * materiality, 4) AS confidence, least(greatest(least(gap * 100, 100.0) + CASE WHEN n < 5 THEN 10.0 ELSE 0.0 END - CASE WHEN materiality < 0.2 THEN 15.0 ELSE 0.0 END, 0.0), 100.0) AS raw FROM g),
unified AS (SELECT cik, n, gap, score, confidence, CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 40 THEN 'MEDIUM' WHEN raw >= 20 THEN 'LOW' ELSE 'NOISE' END AS rank FROM u)"""


def unified(spark, sf):
    """Unified score of every entity: one aggregation by filing before the join, one by entity after it."""
    own = lines(spark, sf).groupBy("accession").agg(F.count_if(F.col("flag") == "R").alias("r"), F.sum("tax").alias("t"), F.count("*").alias("c"))
    own = own.join(filings(spark, sf).select("accession", "cik"), "accession").groupBy("cik").agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.sum("c").alias("n"))
    own = own.select("cik", "n", (F.col("r").cast("double") / F.col("n")).alias("m"), F.least(F.lit(1.0), F.col("t") / 10.0 / F.col("n")).alias("q"))
    return own.select("cik", "n", *[c.alias(k) for k, c in scores.unified_score(F.col("m"), F.col("q"), F.col("n")).items()])


@query(f"WITH {BASE}, k AS (SELECT c.sector, u.cik, u.score, u.rank, u.confidence, row_number() OVER (PARTITION BY c.sector ORDER BY u.score DESC, u.confidence DESC, u.cik) AS position FROM unified u JOIN companies c ON c.cik = u.cik) SELECT sector, cik, score, rank, confidence, CAST(position AS INTEGER) AS position FROM k WHERE position <= 20")
def unified_score_topk(spark, sf):
    """The 20 highest unified scores of each region."""
    out = unified(spark, sf).join(companies(spark, sf).select("cik", "sector"), "cik")
    w = W.partitionBy("sector").orderBy(F.desc("score"), F.desc("confidence"), "cik")
    return out.withColumn("position", F.row_number().over(w)).where("position <= 20").select("sector", "cik", "score", "rank", "confidence", "position")


@query(f"WITH {BASE} SELECT rank, count(*) AS n FROM unified GROUP BY rank")
def unified_rank_counts(spark, sf):
    return unified(spark, sf).groupBy("rank").agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, {PROFILE_SQL} SELECT u.cik, round(u.gap / greatest(p.mean_gap, 0.01) * 0.38, 4) AS calibrated, CASE WHEN u.score >= p.critical THEN 'CRITICAL' WHEN u.score >= p.high THEN 'HIGH' WHEN u.score >= 0.67 * p.high THEN 'MEDIUM' ELSE 'LOW' END AS sector_rank FROM unified u JOIN companies c ON c.cik = u.cik JOIN profiles p ON p.sector = c.sector")
def sector_calibrated_gap(spark, sf):
    """Gap against the sector's mean, ranks by the sector's own thresholds, in whole hundredths: 0.67 of 45 is 30.15 exactly."""
    profiles = spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "sector string, wacc double, critical int, high int, mean_gap double")
    out = unified(spark, sf).join(companies(spark, sf).select("cik", "sector"), "cik").join(F.broadcast(profiles), "sector")  # a row a sector
    score = F.round(F.col("score") * 100).cast("long")
    rank = F.when(score >= 100 * F.col("critical"), "CRITICAL").when(score >= 100 * F.col("high"), "HIGH").when(score >= 67 * F.col("high"), "MEDIUM").otherwise("LOW")
    return out.select("cik", F.round(F.col("gap") / F.greatest("mean_gap", F.lit(0.01)) * 0.38, 4).alias("calibrated"), rank.alias("sector_rank"))


@query("SELECT cik, n, CASE WHEN n <= 0 THEN 0.05 WHEN n <= 2 THEN 0.15 WHEN n <= 5 THEN 0.35 WHEN n <= 10 THEN 0.6 WHEN n <= 20 THEN 0.8 ELSE 1.0 END AS coverage FROM (SELECT c.cik, count(f.accession) AS n FROM companies c LEFT JOIN filings f ON f.cik = c.cik GROUP BY c.cik)")
def coverage_step_score(spark, sf):
    own = filings(spark, sf).groupBy("cik").agg(F.count("*").alias("n"))
    out = companies(spark, sf).select("cik").join(own, "cik", "left").select("cik", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("coverage", scores.coverage_step(F.col("n")))


@query("""SELECT accession, round(least(30 * (seqs / 7.0::DOUBLE) + 25 * (d / 10.0::DOUBLE / n) + 15 * (t / 8.0::DOUBLE / n) + CASE WHEN isodow(filed) = 5 THEN 20 WHEN isodow(filed) >= 4 THEN 10 ELSE 0 END, 100.0), 4) AS burial
FROM (SELECT accession, max(seq) AS seqs, sum(disc) AS d, sum(tax) AS t, count(*) AS n FROM lines GROUP BY accession) JOIN filings USING (accession)""")
def burial_scores(spark, sf):
    own = lines(spark, sf).groupBy("accession").agg(F.max("seq").alias("s"), F.sum("disc").alias("d"), F.sum("tax").alias("t"), F.count("*").alias("n")).join(filings(spark, sf), "accession")
    return own.select("accession", F.round(scores.burial_score(F.col("filed"), F.col("s") / 7.0, F.col("d") / 10.0 / F.col("n"), F.col("t") / 8.0 / F.col("n")), 4).alias("burial"))


WEIGHTS_SQL = "CASE flag WHEN 'R' THEN 2.0 WHEN 'A' THEN 1.8 ELSE 1.0 END::DOUBLE"


@query(f"""WITH s AS (SELECT accession, flag, sum(words) AS w, sum(CASE WHEN status = 'O' THEN words ELSE 0 END) AS ch, sum(disc) AS h, sum(tax) AS sp FROM lines GROUP BY 1, 2),
x AS (SELECT accession, flag, {WEIGHTS_SQL} AS wt, least((0.5 * least(ch * 100.0::DOUBLE / w, 100.0) + 0.3 * h / w * 100 + 0.2 * sp / w * 50) * {WEIGHTS_SQL}, 100.0) AS s FROM s)
SELECT accession, round(least(sum(s * wt) / sum(wt), 100.0), 4) AS materiality FROM x GROUP BY accession""")
def weighted_materiality(spark, sf):
    """Section scores and their weighted mean for each filing."""
    own = lines(spark, sf).groupBy("accession", "flag").agg(F.sum("words").alias("w"), F.sum(F.when(F.col("status") == "O", F.col("words")).otherwise(0)).alias("ch"), F.sum("disc").alias("h"), F.sum("tax").alias("sp"))
    wt = F.when(F.col("flag") == "R", 2.0).when(F.col("flag") == "A", 1.8).otherwise(1.0)
    s = scores.section_score(F.col("ch"), F.col("w"), F.col("h"), F.col("sp"), F.col("w"), wt)
    return own.withColumn("wt", wt).withColumn("s", s).groupBy("accession").agg(F.round(F.least(F.sum(F.col("s") * F.col("wt")) / F.sum("wt"), F.lit(100.0)), 4).alias("materiality"))


@query("SELECT accession, round(materiality / greatest(0.7 * greatest(coverage, 0.01) + 0.3 * burial / 100.0, 0.01), 4) AS gap FROM alerts")
def combined_gaps(spark, sf):
    return alerts(spark, sf).select("accession", F.round(scores.combined_gap(F.col("materiality"), F.col("coverage"), F.col("burial")), 4).alias("gap"))


@query("SELECT accession, CASE WHEN gap >= 80 THEN 'CRITICAL' WHEN gap >= 60 THEN 'HIGH' WHEN gap >= 40 THEN 'MEDIUM' WHEN gap >= 20 THEN 'LOW' ELSE 'SILENT' END AS severity, CASE WHEN gap >= 80 THEN 'email,webhook,in_app' WHEN gap >= 40 THEN 'webhook,in_app' WHEN gap >= 20 THEN 'in_app' ELSE '' END AS channels FROM alerts")
def severity_routing(spark, sf):
    """Severity of a notification and the channels it takes."""
    gap = F.col("gap")
    channels = F.when(gap >= 80, F.array(F.lit("email"), F.lit("webhook"), F.lit("in_app"))).when(gap >= 40, F.array(F.lit("webhook"), F.lit("in_app"))).when(gap >= 20, F.array(F.lit("in_app"))).otherwise(F.array().cast("array<string>"))
    return alerts(spark, sf).select("accession", scores.rank_name(gap, "SILENT").alias("severity"), F.array_join(channels, ",").alias("channels"))


@query("""WITH b AS (SELECT event_type AS bucket, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS hit FROM events GROUP BY 1)
SELECT bucket, n, CASE WHEN n >= 50 THEN round(0.7 * hit + 0.3 * 0.55, 6) ELSE 0.55 END AS confidence, CASE WHEN n >= 50 AND hit > 0.6 THEN 1 WHEN n >= 50 AND hit < 0.4 THEN -1 ELSE 0 END AS direction FROM b""", with_roles=False)
def weight_recalibration(spark, sf):
    """Bucket weights after a backtest: blended confidence, direction where the hit rate is clear."""
    own = read(spark, sf, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("hit"))
    enough = F.col("n") >= 50
    return own.select("bucket", "n", F.when(enough, F.round(0.7 * F.col("hit") + 0.3 * 0.55, 6)).otherwise(0.55).alias("confidence"), F.when(enough & (F.col("hit") > 0.6), 1).when(enough & (F.col("hit") < 0.4), -1).otherwise(0).alias("direction"))


@query("""WITH x AS (SELECT f.accession, sum(words) AS w, lag(sum(words)) OVER (PARTITION BY cik, form ORDER BY filed, f.accession) AS o, sum(disc) AS d, sum(tax) AS t FROM filings f JOIN lines l ON l.accession = f.accession GROUP BY f.accession, cik, form, filed)
SELECT accession, round(greatest(0.0, least(1.0, 0.5 * (abs(w - o) / o::DOUBLE) + 0.3 * (1 - least(w, o) / greatest(w, o)::DOUBLE) + 0.2 * abs((d - t) / w::DOUBLE))), 6) AS materiality FROM x WHERE o IS NOT NULL""")
def item_materiality_change(spark, sf):
    """Materiality of a filing against the one before it."""
    own = lines(spark, sf).groupBy("accession").agg(F.sum("words").alias("w"), F.sum("disc").alias("d"), F.sum("tax").alias("t")).join(filings(spark, sf), "accession")
    own = own.withColumn("o", F.lag("w").over(W.partitionBy("cik", "form").orderBy("filed", "accession"))).where("o is not null")
    m = scores.item_materiality(F.col("w"), F.col("o"), F.least("w", "o") / F.greatest("w", "o"), (F.col("d") - F.col("t")) / F.col("w"))
    return own.select("accession", F.round(m, 6).alias("materiality"))


@query("SELECT accession, round(CASE WHEN articles < 2 THEN 50.0 ELSE least(least(1000 * abs((materiality - burial) / 1000), 100.0) + least(greatest(10 * (articles / 3.0::DOUBLE - 1), 0.0), 30.0), 100.0) END, 4) AS impact FROM alerts")
def price_impacts(spark, sf):
    abnormal = F.when(F.col("articles") >= 2, (F.col("materiality") - F.col("burial")) / 1000)
    return alerts(spark, sf).select("accession", F.round(scores.price_impact(abnormal, F.col("articles") / 3.0), 4).alias("impact"))


@query("SELECT accession, CASE form WHEN '10-K' THEN 'annual' WHEN '10-Q' THEN 'quarterly' WHEN '8-K' THEN 'event' WHEN '4' THEN 'insider' ELSE 'other' END AS grp, concat_ws('; ', CASE WHEN gap >= 60 THEN 'wide gap' END, CASE WHEN burial >= 50 THEN 'buried' END, CASE WHEN articles <= 2 THEN 'little coverage' END) AS reason FROM alerts")
def alert_reasons(spark, sf):
    """Form group and the reasons an alert stands out, in words."""
    groups = F.when(F.col("form") == "10-K", "annual").when(F.col("form") == "10-Q", "quarterly").when(F.col("form") == "8-K", "event").when(F.col("form") == "4", "insider").otherwise("other")
    reason = F.concat_ws("; ", F.when(F.col("gap") >= 60, "wide gap"), F.when(F.col("burial") >= 50, "buried"), F.when(F.col("articles") <= 2, "little coverage"))
    return alerts(spark, sf).select("accession", groups.alias("grp"), reason.alias("reason"))
