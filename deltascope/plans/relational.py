"""Relational queries over companies, filings and alerts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import changes
from ..sources.tables import read
from .base import registrar
from .roles import alerts, companies, filings, lines

QUERIES: dict = {}
query = registrar(QUERIES)


@query("SELECT c.cik, c.name, count(f.accession) AS n_filings, max(f.filed) AS last_filed FROM companies c LEFT JOIN filings f ON c.cik = f.cik GROUP BY c.cik, c.name")
def company_filing_counts(spark, sf):
    """Companies with their number of filings (0 for none) and the last date."""
    own = filings(spark, sf).groupBy("cik").agg(F.count("accession").alias("n"), F.max("filed").alias("last_filed"))
    return companies(spark, sf).join(own, "cik", "left").select("cik", "name", F.coalesce("n", F.lit(0)).alias("n_filings"), "last_filed")


@query("SELECT accession, form, filed FROM filings WHERE cik = 7 AND form IN ('10-K', '10-K/A') ORDER BY filed DESC, accession DESC LIMIT 20 OFFSET 1")
def filings_page(spark, sf):
    """A page of one company's filings of a base form, newest first."""
    own = filings(spark, sf).where((F.col("cik") == 7) & F.regexp_replace("form", "/A$", "").isin("10-K"))
    return own.orderBy(F.desc("filed"), F.desc("accession")).offset(1).limit(20).select("accession", "form", "filed")


@query("SELECT accession, a.cik, c.name, gap, ranking FROM alerts a JOIN companies c ON a.cik = c.cik WHERE ranking >= 3 ORDER BY gap DESC, accession LIMIT 50")
def alerts_by_min_rank(spark, sf):
    """The 50 widest gaps among alerts of rank 3 or more."""
    return alerts(spark, sf).where("ranking >= 3").join(companies(spark, sf), "cik").orderBy(F.desc("gap"), "accession").limit(50).select("accession", "cik", "name", "gap", "ranking")


@query("SELECT accession, gap, filed FROM alerts WHERE cik = 7 ORDER BY filed DESC, gap DESC, accession LIMIT 10")
def company_alerts(spark, sf):
    return alerts(spark, sf).where("cik = 7").orderBy(F.desc("filed"), F.desc("gap"), "accession").limit(10).select("accession", "gap", "filed")


@query("SELECT accession, gap FROM alerts ORDER BY gap DESC, accession LIMIT 25 OFFSET 25")
def alerts_page(spark, sf):
    return alerts(spark, sf).orderBy(F.desc("gap"), "accession").offset(25).limit(25).select("accession", "gap")


@query("""
SELECT c.cik, count(DISTINCT f.accession) AS n_filings, max(f.filed) AS last_filed, max(a.gap) AS max_gap, max(a.ranking) AS max_rank, count(DISTINCT a.accession) AS n_alerts, round(max(g.mean) / 100, 3) AS mean_gap
FROM companies c LEFT JOIN filings f ON f.cik = c.cik AND f.fetched LEFT JOIN alerts a ON a.cik = c.cik LEFT JOIN (SELECT cik, avg(CAST(round(gap * 100) AS BIGINT)) AS mean FROM alerts GROUP BY cik) g ON g.cik = c.cik GROUP BY c.cik""")
def watchlist_rollup(spark, sf):
    """Companies with fetched filings and alerts; each side is aggregated before it is joined."""
    f = filings(spark, sf).where("fetched").groupBy("cik").agg(F.count("accession").alias("nf"), F.max("filed").alias("last_filed"))
    a = alerts(spark, sf).groupBy("cik").agg(F.max("gap").alias("max_gap"), F.max("ranking").alias("max_rank"), F.count("*").alias("na"), F.round(F.avg(F.round(F.col("gap") * 100).cast("long")) / 100, 3).alias("mean_gap"))
    return companies(spark, sf).select("cik").join(f, "cik", "left").join(a, "cik", "left").select("cik", F.coalesce("nf", F.lit(0)).alias("n_filings"), "last_filed", "max_gap", "max_rank", F.coalesce("na", F.lit(0)).alias("n_alerts"), "mean_gap")


@query("SELECT cik, count(*) AS n_alerts, count(CASE WHEN ranking >= 3 THEN 1 END) AS n_high, max(gap) AS max_gap, min(filed) AS first_filed FROM alerts GROUP BY cik HAVING count(*) > 0")
def company_alert_stats(spark, sf):
    return alerts(spark, sf).groupBy("cik").agg(F.count("*").alias("n_alerts"), F.count_if(F.col("ranking") >= 3).alias("n_high"), F.max("gap").alias("max_gap"), F.min("filed").alias("first_filed"))


STATS = "SELECT c.sector, a.materiality AS m, a.gap AS g, a.ranking, a.accession, a.cik FROM alerts a JOIN companies c ON a.cik = c.cik"


@query(f"WITH s AS ({STATS}) SELECT sector, round(avg(m), 4) AS mean, round(median(m), 4) AS median, round(coalesce(stddev_samp(m), 0), 4) AS sd, min(m) AS low, max(m) AS high, count(*) AS n FROM s GROUP BY sector")
def sector_stats(spark, sf):
    """Mean, median, sample deviation, range and count of materiality by sector."""
    own = alerts(spark, sf).join(companies(spark, sf), "cik")
    return own.groupBy("sector").agg(F.round(F.avg("materiality"), 4).alias("mean"), F.round(F.median("materiality"), 4).alias("median"), F.round(F.coalesce(F.stddev_samp("materiality"), F.lit(0.0)), 4).alias("sd"), F.min("materiality").alias("low"), F.max("materiality").alias("high"), F.count("*").alias("n"))


@query(f"WITH s AS ({STATS}), p AS (SELECT cik, sector, max(m) AS m FROM s GROUP BY cik, sector) SELECT cik, sector, m, round((rank() OVER (PARTITION BY sector ORDER BY m) - 1) * 100.0 / count(*) OVER (PARTITION BY sector), 1) AS pct FROM p")
def sector_percentile(spark, sf):
    """Share of the sector's companies strictly below each one; running counts over the distinct values, not the companies."""
    own = alerts(spark, sf).groupBy("cik").agg(F.max("materiality").alias("m")).join(companies(spark, sf).select("cik", "sector"), "cik")
    values = own.groupBy("sector", "m").agg(F.count("*").alias("c"))
    w = W.partitionBy("sector")
    ranks = values.select("sector", "m", (F.sum("c").over(w.orderBy("m")) - F.col("c")).alias("below"), F.sum("c").over(w).alias("n"))
    return own.join(ranks, ["sector", "m"]).select("cik", "sector", "m", F.round(F.col("below") * 100.0 / F.col("n"), 1).alias("pct"))


@query(f"""WITH s AS ({STATS}), p AS (SELECT cik, sector, max(m) AS m FROM s GROUP BY cik, sector),
z AS (SELECT *, avg(m) OVER (PARTITION BY sector) AS mu, stddev_samp(m) OVER (PARTITION BY sector) AS sd FROM p)
SELECT cik, sector, CASE WHEN sd IS NULL OR sd = 0 THEN 'NORMAL' WHEN (m - mu) / sd >= 1.5 THEN 'HIGH' WHEN (m - mu) / sd <= -1.5 THEN 'LOW' ELSE 'NORMAL' END AS flag FROM z""")
def sector_outliers(spark, sf):
    own = alerts(spark, sf).groupBy("cik").agg(F.max("materiality").alias("m")).join(companies(spark, sf).select("cik", "sector"), "cik")
    stats = own.groupBy("sector").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))  # a row a sector
    z = F.when(F.col("sd") > 0, (F.col("m") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return own.join(stats, "sector").withColumn("z", z).select("cik", "sector", F.when(F.col("z") >= 1.5, "HIGH").when(F.col("z") <= -1.5, "LOW").otherwise("NORMAL").alias("flag"))


@query(f"WITH s AS ({STATS}), p AS (SELECT cik, max(g) AS g FROM s WHERE sector = 'ASIA' GROUP BY cik) SELECT c.cik, coalesce(p.g, 0) AS metric FROM companies c LEFT JOIN p ON p.cik = c.cik WHERE c.sector = 'ASIA' ORDER BY metric DESC, c.cik LIMIT 10")
def sector_leaderboard(spark, sf):
    own = alerts(spark, sf).groupBy("cik").agg(F.max("gap").alias("g"))
    return companies(spark, sf).where("sector = 'ASIA'").join(own, "cik", "left").select("cik", F.coalesce("g", F.lit(0.0)).alias("metric")).orderBy(F.desc("metric"), "cik").limit(10)


@query(f"""WITH s AS ({STATS}), p AS (SELECT cik, sector, max(m) / 100 AS score FROM s GROUP BY cik, sector),
h AS (SELECT sector, round(avg(score), 6) AS mean, max(score) AS high, min(score) AS low, count(*) AS n, count(*) FILTER (WHERE score >= 0.7) AS risky FROM p GROUP BY sector),
t AS (SELECT sector, string_agg(cik, ', ' ORDER BY score DESC, cik) AS tickers FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, cik) AS k FROM p) WHERE k <= 10 GROUP BY sector)
SELECT h.sector, mean, high, low, n, risky, tickers, CASE WHEN mean >= 0.85 THEN 'CRITICAL' WHEN mean >= 0.65 THEN 'HIGH' WHEN mean >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM h JOIN t ON h.sector = t.sector""")
def heatmap(spark, sf):
    """Sector risk: means, extremes, count of risky members and the ten riskiest."""
    own = alerts(spark, sf).groupBy("cik").agg((F.max("materiality") / 100).alias("score")).join(companies(spark, sf).select("cik", "sector"), "cik")
    # the filter alone on the rank lets each task keep its own ten
    best = own.withColumn("k", F.row_number().over(W.partitionBy("sector").orderBy(F.desc("score"), "cik"))).where("k <= 10")
    top = best.groupBy("sector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "cik"))), lambda x: x["cik"].cast("string")), ", ").alias("tickers"))
    out = own.groupBy("sector").agg(F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("high"), F.min("score").alias("low"), F.count("*").alias("n"), F.count_if(F.col("score") >= 0.7).alias("risky")).join(top, "sector")
    return out.withColumn("level", F.when(F.col("mean") >= 0.85, "CRITICAL").when(F.col("mean") >= 0.65, "HIGH").when(F.col("mean") >= 0.4, "MEDIUM").otherwise("LOW"))


@query("""WITH a1 AS (SELECT cik, max(materiality) / 100 AS s FROM alerts WHERE form = '10-K' GROUP BY cik), b AS (SELECT cik, max(burial) / 100 AS s FROM alerts WHERE form = '8-K' GROUP BY cik)
SELECT coalesce(a1.cik, b.cik) AS cik, round(0.6 * coalesce(a1.s, 0) + 0.4 * coalesce(b.s, 0), 6) AS score FROM a1 FULL JOIN b ON a1.cik = b.cik""")
def heatmap_merge(spark, sf):
    """Filing and news scores merged, 0 where one is missing."""
    a = alerts(spark, sf).where("form = '10-K'").groupBy("cik").agg((F.max("materiality") / 100).alias("s"))
    b = alerts(spark, sf).where("form = '8-K'").groupBy("cik").agg((F.max("burial") / 100).alias("t"))
    return a.join(b, "cik", "full_outer").select("cik", F.round(0.6 * F.coalesce("s", F.lit(0.0)) + 0.4 * F.coalesce("t", F.lit(0.0)), 6).alias("score"))


@query(f"WITH s AS ({STATS}) SELECT sector, count(*) FILTER (WHERE ranking = 1) AS r1, count(*) FILTER (WHERE ranking = 2) AS r2, count(*) FILTER (WHERE ranking >= 3) AS r3, round(avg(g), 3) AS mean_gap FROM s GROUP BY sector")
def market_snapshot(spark, sf):
    own = alerts(spark, sf).join(companies(spark, sf), "cik")
    r = F.col("ranking")
    return own.groupBy("sector").agg(F.count_if(r == 1).alias("r1"), F.count_if(r == 2).alias("r2"), F.count_if(r >= 3).alias("r3"), F.round(F.avg("gap"), 3).alias("mean_gap"))


@query("""WITH p AS (SELECT cik, sector, CAST(round(greatest(balance, 0) * 100) AS BIGINT) AS cents FROM companies)
SELECT sector, CAST(sum(cents) AS BIGINT) AS cents, round(sum(cents) * 100.0::DOUBLE / (SELECT sum(cents) FROM p), 4) AS weight FROM p GROUP BY sector""")
def sector_weights(spark, sf):
    """Total cost and weight of a portfolio by sector."""
    own = companies(spark, sf).withColumn("cents", F.round(F.greatest("balance", F.lit(0.0)) * 100).cast("long")).groupBy("sector").agg(F.sum("cents").alias("cents"))
    return own.withColumn("weight", F.round(F.col("cents") * F.lit(100.0) / own.agg(F.sum("cents")).scalar(), 4))


@query("""WITH p AS (SELECT cik, CAST(round(greatest(balance, 0) * 100) AS BIGINT) AS cents FROM companies WHERE balance > 0), t AS (SELECT CAST(sum(cents) AS DOUBLE) AS total FROM p)
SELECT a.accession, a.cik, round(a.materiality * p.cents / t.total, 6) AS weighted FROM alerts a JOIN p ON a.cik = p.cik CROSS JOIN t WHERE a.materiality >= 60""")
def portfolio_weighted_alerts(spark, sf):
    """Alerts on held positions, weighted by exposure."""
    own = companies(spark, sf).where("balance > 0").select("cik", F.round(F.greatest("balance", F.lit(0.0)) * 100).cast("long").alias("cents"))
    own = own.withColumn("total", own.agg(F.sum("cents")).scalar().cast("double"))
    return alerts(spark, sf).where("materiality >= 60").join(own, "cik").select("accession", "cik", F.round(F.col("materiality") * F.col("cents") / F.col("total"), 6).alias("weighted"))


@query("""WITH r AS (SELECT accession, cik, form, filed, row_number() OVER (PARTITION BY cik, form ORDER BY filed DESC, accession DESC) AS k FROM filings)
SELECT n.cik, n.form, n.accession AS latest, p.accession AS prior FROM r n JOIN r p ON n.cik = p.cik AND n.form = p.form AND p.k = 2 WHERE n.k = 1""")
def latest_vs_prior_pairs(spark, sf):
    """The latest filing of each company and form with the one before it, in one pass."""
    w = W.partitionBy("cik", "form").orderBy(F.desc("filed"), F.desc("accession"))
    own = filings(spark, sf).select("cik", "form", F.col("accession").alias("latest"), F.lead("accession").over(w).alias("prior"), F.row_number().over(w).alias("k"))
    return own.where("k = 1 and prior is not null").select("cik", "form", "latest", "prior")


@query("""WITH r AS (SELECT accession, cik, form, lag(accession) OVER (PARTITION BY cik, form ORDER BY filed, accession) AS prior FROM filings), done AS (SELECT accession FROM lines WHERE flag = 'R')
SELECT accession, prior FROM r WHERE prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM done d WHERE d.accession = r.accession)""")
def undiffed_pairs_anti(spark, sf):
    """Pairs of filings not compared yet."""
    own = filings(spark, sf).withColumn("prior", F.lag("accession").over(W.partitionBy("cik", "form").orderBy("filed", "accession"))).where("prior is not null")
    return own.join(lines(spark, sf).where("flag = 'R'").select("accession").distinct(), "accession", "left_anti").select("accession", "prior")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND length(d.text) > 100", with_roles=False)
def pending_docs_anti(spark, sf):
    """Documents without a label, longer than 100 characters."""
    return read(spark, sf, "documents").where(F.length("text") > 100).join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT accession FROM filings WHERE cik IN (SELECT cik FROM companies WHERE segment = 'BUILDING')")
def watchlist_semi_join(spark, sf):
    return filings(spark, sf).join(companies(spark, sf).where("segment = 'BUILDING'").select("cik"), "cik", "left_semi").select("accession")


@query("""WITH o AS (SELECT flag AS key, count(*) AS n FROM lines WHERE accession % 2 = 0 GROUP BY 1), n AS (SELECT status AS key, count(*) AS n FROM lines WHERE accession % 2 = 1 GROUP BY 1)
SELECT coalesce(o.key, n.key) AS key, o.n AS n_old, n.n AS n_new, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.n = n.n THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.key = n.key""")
def section_key_full_outer(spark, sf):
    """Union of two versions' section keys with their status."""
    o = lines(spark, sf).where("accession % 2 = 0").groupBy(F.col("flag").alias("key")).agg(F.count("*").alias("n_old"))
    n = lines(spark, sf).where("accession % 2 = 1").groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n_new"))
    change = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(F.col("n_old") == F.col("n_new"), "unchanged").otherwise("modified")
    return o.join(n, "key", "full_outer").withColumn("change", change)


@query("SELECT c.sector, f.form, count(*) AS n FROM filings f JOIN companies c ON f.cik = c.cik GROUP BY c.sector, f.form")
def cross_sector_table(spark, sf):
    return filings(spark, sf).join(companies(spark, sf), "cik").groupBy("sector", "form").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT cik FROM alerts WHERE ranking >= 2")
def alerted_companies(spark, sf):
    return alerts(spark, sf).where("ranking >= 2").select("cik").distinct()


@query("SELECT a.accession, a.filed FROM alerts a LEFT JOIN (SELECT DISTINCT accession FROM lines WHERE flag = 'A') p ON p.accession = a.accession WHERE p.accession IS NULL ORDER BY a.filed DESC, a.accession LIMIT 100")
def unenriched_alerts(spark, sf):
    """The newest alerts still without price data."""
    return alerts(spark, sf).join(lines(spark, sf).where("flag = 'A'").select("accession").distinct(), "accession", "left_anti").orderBy(F.desc("filed"), "accession").limit(100).select("accession", "filed")


@query("SELECT accession, seq, flag, words FROM lines WHERE words < 45 OR flag = 'N' ORDER BY CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, coalesce(words, 0) DESC, accession, seq LIMIT 40")
def unclassified_changes(spark, sf):
    """Changes by priority of their type, longest first."""
    order = F.when(F.col("flag") == "R", 0).when(F.col("flag") == "A", 1).otherwise(2)
    return lines(spark, sf).where("words < 45 or flag = 'N'").orderBy(order, F.coalesce("words", F.lit(0)).desc(), "accession", "seq").limit(40).select("accession", "seq", "flag", "words")


@query("SELECT accession, seq, flag FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY CASE flag WHEN 'R' THEN 0 ELSE 1 END, words DESC, seq) AS k FROM lines WHERE flag IN ('R', 'A')) WHERE k <= 5")
def top_changes_per_filing(spark, sf):
    order = W.partitionBy("accession").orderBy(F.when(F.col("flag") == "R", 0).otherwise(1), F.desc("words"), "seq")
    return lines(spark, sf).where(F.col("flag").isin("R", "A")).withColumn("k", F.row_number().over(order)).where("k <= 5").select("accession", "seq", "flag")


@query("SELECT d.doc_id FROM documents d WHERE d.lang = 'en' AND d.text ILIKE '%THATIN%' ORDER BY d.doc_id LIMIT 50", with_roles=False)
def filing_keyword_search(spark, sf):
    """Case-insensitive keyword search with a language filter."""
    return read(spark, sf, "documents").where((F.col("lang") == "en") & F.col("text").ilike("%THATIN%")).orderBy("doc_id").limit(50).select("doc_id")


@query("SELECT segment, count(*) AS n FROM companies GROUP BY segment ORDER BY n DESC, segment")
def sector_counts(spark, sf):
    return companies(spark, sf).groupBy("segment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "segment")


@query("SELECT event_type AS channel, count(*) AS total, count(*) FILTER (WHERE value >= 50) AS ok, round(100.0 * count(*) FILTER (WHERE value >= 50) / count(*), 1) AS rate FROM events GROUP BY event_type", with_roles=False)
def dispatch_success_rate(spark, sf):
    ok = F.count_if(F.col("value") >= 50)
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("total"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 1).alias("rate"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30", with_roles=False)
def history_newest(spark, sf):
    return read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "ts")


@query("SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS position FROM customer", with_roles=False)
def waitlist_position(spark, sf):
    """Places in each list: ranks within ranges of a thousand keys, on top of the sizes of the ranges before."""
    own = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("list"), F.expr("c_custkey div 1000").alias("lot"))
    w = W.partitionBy("list")
    before = own.groupBy("list", "lot").agg(F.count("*").alias("c")).select("list", "lot", (F.sum("c").over(w.orderBy("lot")) - F.col("c")).alias("before"))
    return own.withColumn("k", F.row_number().over(W.partitionBy("list", "lot").orderBy("id"))).join(before, ["list", "lot"]).select("id", (F.col("before") + F.col("k")).alias("position"))


@query("SELECT f.accession, d.seq, c.name FROM filings f JOIN lines d ON d.accession = f.accession AND d.flag = 'R' JOIN companies c ON c.cik = f.cik WHERE f.form = '10-K'")
def reextract_three_way(spark, sf):
    own = filings(spark, sf).where("form = '10-K'").join(lines(spark, sf).where("flag = 'R'"), "accession").join(companies(spark, sf), "cik")
    return own.select("accession", "seq", "name")


@query("SELECT DISTINCT cik FROM filings WHERE form = '10-K' UNION SELECT DISTINCT cik FROM filings WHERE form = '8-K'")
def key_union(spark, sf):
    own = filings(spark, sf)
    return own.where("form = '10-K'").select("cik").union(own.where("form = '8-K'").select("cik")).distinct()


@query("SELECT DISTINCT cik FROM filings WHERE form = '10-K' EXCEPT SELECT cik FROM filings WHERE form = '8-K'")
def key_difference(spark, sf):
    own = filings(spark, sf)
    return own.where("form = '10-K'").select("cik").distinct().join(own.where("form = '8-K'").select("cik").distinct(), "cik", "left_anti")


@query("SELECT DISTINCT cik FROM filings WHERE form = '10-K' INTERSECT SELECT cik FROM filings WHERE form = '8-K'")
def key_intersection(spark, sf):
    own = filings(spark, sf)
    return own.where("form = '10-K'").select("cik").intersect(own.where("form = '8-K'").select("cik"))


@query("SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS page_id FROM pages WHERE coalesce(url, '') <> '' GROUP BY 1", with_roles=False)
def url_dedupe(spark, sf):
    """First article of each address, blank addresses dropped."""
    own = read(spark, sf, "pages").where(F.coalesce("url", F.lit("")) != "")
    return own.groupBy(F.regexp_replace("url", "[?#].*$", "").alias("url")).agg(F.min("page_id").alias("page_id"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY filed DESC, accession DESC) AS k FROM filings) SELECT accession, form, filed FROM r WHERE k <= 8 ORDER BY filed DESC, accession DESC LIMIT 24""")
def top_n_per_form_capped(spark, sf):
    """The newest eight of each form, 24 in all."""
    own = filings(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("form").orderBy(F.desc("filed"), F.desc("accession")))).where("k <= 8")
    return own.orderBy(F.desc("filed"), F.desc("accession")).limit(24).select("accession", "form", "filed")


@query("SELECT accession, form, filed FROM filings WHERE form IN ('10-K', '10-K/A') AND filed >= DATE '1996-01-01' ORDER BY filed DESC, accession DESC LIMIT 40")
def select_forms_topk(spark, sf):
    """Filings of a base form, amendments kept, since a date, newest first."""
    base = F.regexp_replace(F.upper(F.trim("form")), "/A$", "")
    return filings(spark, sf).where(base.isin("10-K") & (F.col("filed") >= "1996-01-01")).orderBy(F.desc("filed"), F.desc("accession")).limit(40).select("accession", "form", "filed")


@query("""WITH m AS (SELECT max(date_trunc('month', filed)) AS last FROM filings), k AS (SELECT CAST(unnest(generate_series(0, 11)) AS INTEGER) AS i)
SELECT CAST(m.last - to_months(k.i) AS DATE) AS month, (SELECT count(*) FROM filings f WHERE date_trunc('month', f.filed) = m.last - to_months(k.i)) AS n FROM m CROSS JOIN k""")
def filings_per_month(spark, sf):
    """Filings of the last twelve months, empty months included."""
    own = filings(spark, sf).groupBy(F.trunc("filed", "month").alias("month")).agg(F.count("*").alias("n"))
    months = own.agg(F.max("month").alias("last")).select(F.explode(F.sequence(F.add_months("last", -11), F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return months.join(own, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS item FROM part) GROUP BY item ORDER BY n DESC, item LIMIT 12", with_roles=False)
def multi_value_item_counts(spark, sf):
    return read(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(12)


@query("""WITH s AS (SELECT cik, name, CASE WHEN name = 'Customer#000000012' THEN 0 WHEN name LIKE 'Customer#00000001%' THEN 1 WHEN regexp_matches(name, '#0*12') THEN 2 WHEN contains(name, '12') THEN 3 END AS stage FROM companies)
SELECT cik, stage FROM s WHERE stage IS NOT NULL ORDER BY stage, cik LIMIT 8""")
def company_search_staged(spark, sf):
    """Exact name, prefix, word prefix, then substring; eight results."""
    name = F.col("name")
    stage = F.when(name == "Customer#000000012", 0).when(name.startswith("Customer#00000001"), 1).when(name.rlike("#0*12"), 2).when(name.contains("12"), 3)
    return companies(spark, sf).select("cik", stage.alias("stage")).where("stage is not null").orderBy("stage", "cik").limit(8)


@query("SELECT page_id FROM pages WHERE list_bool_and(list_transform(string_split('en blog', ' '), lambda w: contains(lower(url), w)))", with_roles=False)
def haystack_all_words(spark, sf):
    """Every word of the question occurs in the haystack."""
    return read(spark, sf, "pages").where(F.forall(F.split(F.lit("en blog"), " +"), lambda w: F.lower("url").contains(w))).select("page_id")


#: The old side of the changes: every company. The new side: every supplier, whose keys partly meet those of the companies.
OLD = "o AS (SELECT cik, CASE WHEN balance < 0 THEN '' ELSE nation END AS name FROM companies)"
NEW = "n AS (SELECT s_suppkey * 20 AS cik, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS name FROM supplier)"


def _sides(spark, sf):
    old = companies(spark, sf).select("cik", F.when(F.col("balance") < 0, "").otherwise(F.col("nation")).alias("name"))
    new = read(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("cik"), F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("name"))
    return old, new


@query(f"WITH {OLD}, {NEW} SELECT coalesce(n.cik, o.cik) AS cik, CASE WHEN n.cik IS NOT NULL THEN n.name ELSE o.name END AS name FROM o FULL JOIN n ON o.cik = n.cik")
def upsert_latest_wins(spark, sf):
    """New rows written over old ones by key."""
    return changes.upsert(*_sides(spark, sf), ["cik"])


@query(f"WITH {OLD}, {NEW} SELECT coalesce(n.cik, o.cik) AS cik, CASE WHEN n.cik IS NOT NULL AND n.name <> '' THEN n.name ELSE o.name END AS name FROM o FULL JOIN n ON o.cik = n.cik")
def upsert_keep_if_empty(spark, sf):
    """An empty new name does not replace the old one."""
    return changes.upsert(*_sides(spark, sf), ["cik"], keep_if_empty=["name"])


@query(f"WITH {OLD}, {NEW} SELECT cik, name FROM o UNION ALL SELECT cik, name FROM n WHERE cik NOT IN (SELECT cik FROM o)")
def insert_or_ignore_keys(spark, sf):
    return changes.insert_or_ignore(*_sides(spark, sf), ["cik"])


@query(f"WITH {OLD}, {NEW} SELECT cik, name, 'old' AS origin FROM o WHERE cik NOT IN (SELECT cik FROM n) UNION ALL SELECT cik, name, CAST(NULL AS VARCHAR) FROM n")
def insert_or_replace_rows(spark, sf):
    old, new = _sides(spark, sf)
    return changes.insert_or_replace(old.withColumn("origin", F.lit("old")), new, ["cik"])


@query("SELECT accession, seq, flag FROM lines WHERE accession NOT IN (SELECT accession FROM lines WHERE accession % 5 = 0 AND seq = 1) UNION ALL SELECT accession, seq, 'X' FROM lines WHERE accession % 5 = 0 AND seq = 1")
def replace_child_rows(spark, sf):
    own = lines(spark, sf).select("accession", "seq", "flag")
    return changes.replace_children(own, own.where("accession % 5 = 0 and seq = 1").withColumn("flag", F.lit("X")), ["accession"])


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - 7", with_roles=False)
def retention_prune(spark, sf):
    own = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return changes.retain(own, "day", own.agg(F.max("day")).scalar(), 7).select("event_id")


@query("SELECT cik, accession, form, filed FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS k FROM filings) WHERE k = 1")
def dedupe_latest(spark, sf):
    return changes.latest(filings(spark, sf), ["cik"], [F.desc("filed"), F.desc("accession")]).select("cik", "accession", "form", "filed")


@query("""SELECT accession, array_to_string(list_filter([CASE WHEN NOT regexp_matches(CAST(accession AS VARCHAR), '^[0-9]{1,4}$') THEN 'accession' END, CASE WHEN form NOT IN ('10-K', '10-Q', '8-K') THEN 'form' END, CASE WHEN amount > 300000 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS errors FROM filings""")
def validation_report(spark, sf):
    """Names of the rules that each filing breaks."""
    errors = F.array_compact(F.array(F.when(~F.col("accession").cast("string").rlike("^[0-9]{1,4}$"), "accession"), F.when(~F.col("form").isin("10-K", "10-Q", "8-K"), "form"), F.when(F.col("amount") > 300000, "range")))
    return filings(spark, sf).select("accession", F.array_join(errors, ",").alias("errors"))


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS host FROM pages)
SELECT page_id, host, CASE WHEN starts_with(host, 'm.') THEN -1 WHEN regexp_matches(host, '^(blog|news)') THEN 2 WHEN ends_with(host, '.org') THEN 0 WHEN ends_with(host, '.net') THEN 1 ELSE 3 END AS tier FROM h""", with_roles=False)
def source_validation(spark, sf):
    """Block list, patterns, allow list, then unknown."""
    host = F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^www\.", "")
    tier = F.when(F.col("host").startswith("m."), -1).when(F.col("host").rlike("^(blog|news)"), 2).when(F.col("host").endswith(".org"), 0).when(F.col("host").endswith(".net"), 1).otherwise(3)
    return read(spark, sf, "pages").select("page_id", host.alias("host")).withColumn("tier", tier)


@query("SELECT accession, lpad(CAST(accession AS VARCHAR), 10, '0') || '-' || strftime(filed, '%y') || '-' || lpad(CAST(cik AS VARCHAR), 6, '0') AS canonical, form LIKE '%/A' AS is_amendment, regexp_replace(form, '/A$', '') AS base_form, strftime(filed, '%b %-d, %Y') AS shown FROM filings")
def normalized_filings(spark, sf):
    """Canonical accession numbers, base forms and display dates."""
    raw = F.concat(F.lpad(F.col("accession").cast("string"), 10, "0"), F.date_format("filed", "yy"), F.lpad(F.col("cik").cast("string"), 6, "0"))
    canonical = F.regexp_replace(raw, r"^(\d{10})-?(\d{2})-?(\d{6})$", "$1-$2-$3")
    return filings(spark, sf).select("accession", canonical.alias("canonical"), F.col("form").rlike("/A$").alias("is_amendment"), F.regexp_replace("form", "/A$", "").alias("base_form"), F.date_format("filed", "MMM d, yyyy").alias("shown"))
