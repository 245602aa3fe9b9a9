"""As-of, interval and window queries, trends and the event study.

Prices stand in ``events``: the mean value of an entity (user_id) a day, in whole hundredths.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import study, temporal
from ..sources.tables import read
from .base import registrar
from .roles import alerts, companies, filings

QUERIES: dict = {}
query = registrar(QUERIES)

PRICES = "prices AS (SELECT CAST(user_id % 50 AS BIGINT) AS ticker, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS close, CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1, 2)"


def prices(spark, sf):
    """(ticker, day, close, volume), one row an entity and day."""
    return read(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("ticker"), F.to_date("ts").alias("day")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("close"), F.count("*").alias("volume"))


@query("SELECT n.accession, (SELECT max(o.filed) FROM filings o WHERE o.cik = n.cik AND o.form = n.form AND o.filed < n.filed) AS prior_filed FROM filings n")
def prior_comparable_asof(spark, sf):
    """Date of the latest earlier filing of the same company and form."""
    own = filings(spark, sf).select("accession", "cik", "form", "filed")
    right = own.select("cik", "form", "filed", F.col("filed").alias("prior_filed"))
    return temporal.asof_backward(own, right, ["cik", "form"], "filed", ["prior_filed"], strict=True).select("accession", "prior_filed")


@query("""WITH x AS (SELECT n.accession, n.filed, o.accession AS prior, row_number() OVER (PARTITION BY n.accession ORDER BY o.filed DESC, o.accession DESC) AS k
FROM filings n JOIN filings o ON o.cik = n.cik AND regexp_replace(o.form, '/A$', '') = regexp_replace(n.form, '/A$', '') AND o.form NOT LIKE '%/A' AND o.fetched AND o.filed < n.filed) SELECT accession, prior FROM x WHERE k = 1""")
def previous_same_base_form(spark, sf):
    """The latest earlier fetched original of the same base form."""
    own = filings(spark, sf).withColumn("base", F.regexp_replace("form", "/A$", ""))
    right = own.where("fetched and form not like '%/A'").select("cik", "base", "filed", F.col("accession").alias("prior"))
    return temporal.asof_backward(own.select("accession", "cik", "base", "filed"), right, ["cik", "base"], "filed", ["prior"], strict=True).where("prior is not null").select("accession", "prior")


@query("""WITH a AS (SELECT * FROM filings WHERE form = '10-K/A'), o AS (SELECT * FROM filings WHERE form = '10-K'),
x AS (SELECT a.accession, a.filed, o.accession AS amends, row_number() OVER (PARTITION BY a.accession ORDER BY o.filed DESC, o.accession DESC) AS k FROM a JOIN o ON o.cik = a.cik AND o.filed <= a.filed)
SELECT a.accession, x.amends, CASE WHEN x.amends IS NULL THEN 2 ELSE 1 + row_number() OVER (PARTITION BY x.amends ORDER BY a.filed, a.accession) END AS version FROM a LEFT JOIN x ON x.accession = a.accession AND x.k = 1""")
def amendment_versions(spark, sf):
    """Amendments with the original they amend and their version of it; orphans are version 2."""
    own = filings(spark, sf)
    a = own.where("form = '10-K/A'").select("accession", "cik", "filed")
    o = own.where("form = '10-K'").select("cik", "filed", F.col("accession").alias("amends"))
    out = temporal.asof_backward(a, o, ["cik"], "filed", ["amends"])
    return temporal.numbered_of(out, "amends", ["filed", "accession"], "version").select("accession", "amends", "version")


@query("""WITH e AS (SELECT accession, filed, cik % 50 AS ticker FROM filings WHERE form = '8-K'), p AS (SELECT event_id, user_id % 50 AS ticker, ts FROM events),
x AS (SELECT e.accession, p.event_id, row_number() OVER (PARTITION BY e.accession ORDER BY p.ts DESC, p.event_id DESC) AS k FROM (SELECT accession, ticker, TIMESTAMP '2024-01-03' + to_days(CAST(accession % 25 AS INTEGER)) AS at FROM e) e JOIN p ON p.ticker = e.ticker AND p.ts >= e.at - INTERVAL 2 DAY AND p.ts < e.at)
SELECT accession, event_id FROM x WHERE k <= 5""")
def precursor_interval_join(spark, sf):
    """The newest articles in the two days before each event."""
    e = filings(spark, sf).where("form = '8-K'").select("accession", (F.col("cik") % 50).alias("ticker"), F.expr("timestamp'2024-01-03' + make_interval(0, 0, 0, cast(accession % 25 as int))").alias("at"))
    p = read(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("ticker"), "ts")
    out = temporal.asof_last_k(e, p.withColumnRenamed("ts", "at"), "accession", ["ticker"], "at", ["event_id"], 5, within="2 DAYS", tie="event_id")
    return out.select("accession", "event_id")


@query("""WITH e AS (SELECT accession, cik % 50 AS ticker, DATE '2024-01-01' + CAST(accession % 40 AS INTEGER) AS d FROM filings WHERE form = '10-Q'), a AS (SELECT event_id, user_id % 50 AS ticker, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click'),
x AS (SELECT e.accession, a.event_id, a.day BETWEEN e.d - 1 AND e.d + 3 AS inside FROM e JOIN a ON a.ticker = e.ticker), w AS (SELECT *, bool_or(inside) OVER (PARTITION BY accession) AS any_inside FROM x)
SELECT accession, count(*) AS n FROM w WHERE inside OR NOT any_inside GROUP BY accession""")
def window_filter_with_fallback(spark, sf):
    """Articles near a filing, or all of the company's if none is near: two as-of lookups in running counts by day."""
    e = filings(spark, sf).where("form = '10-Q'").select("accession", (F.col("cik") % 50).alias("ticker"), F.expr("date_add(date'2024-01-01', cast(accession % 40 as int))").alias("d"))
    a = read(spark, sf, "events").where("event_type = 'click'").groupBy((F.col("user_id") % 50).alias("ticker"), F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    a = a.select("ticker", "day", F.sum("c").over(W.partitionBy("ticker").orderBy("day")).alias("upto"))
    every = a.groupBy("ticker").agg(F.max("upto").alias("every"))
    e = e.withColumn("d", F.date_add("d", 3))
    e = temporal.asof_backward(e, a.select("ticker", F.col("day").alias("d"), F.col("upto").alias("last")), ["ticker"], "d", ["last"]).withColumn("d", F.date_sub("d", 5))
    e = temporal.asof_backward(e, a.select("ticker", F.col("day").alias("d"), F.col("upto").alias("first")), ["ticker"], "d", ["first"])
    near = F.coalesce("last", F.lit(0)) - F.coalesce("first", F.lit(0))
    return e.join(every, "ticker").select("accession", F.when(near > 0, near).otherwise(F.col("every")).alias("n"))


@query(f"""WITH {PRICES}, s AS (SELECT ticker, day, close, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY day)),
e AS (SELECT accession, cik % 50 AS ticker, DATE '2024-01-01' + CAST(accession % 28 AS INTEGER) AS d FROM filings WHERE form = '4'), x AS (SELECT e.accession, s.*, row_number() OVER (PARTITION BY e.accession ORDER BY s.day) AS k FROM e JOIN s ON s.ticker = e.ticker AND s.day >= e.d)
SELECT accession, day AS base_day, round(c1 / close - 1, 6) AS r1, round(c3 / close - 1, 6) AS r3, round(c5 / close - 1, 6) AS r5 FROM x WHERE k = 1 AND close > 0""")
def forward_returns(spark, sf):
    """Returns 1, 3 and 5 trading days after the first trading day at or after an event."""
    w = W.partitionBy("ticker").orderBy("day")
    s = prices(spark, sf).select("ticker", "day", "close", *[F.lead("close", n).over(w).alias(f"c{n}") for n in (1, 3, 5)]).withColumn("base_day", F.col("day"))
    e = filings(spark, sf).where("form = '4'").select("accession", (F.col("cik") % 50).alias("ticker"), F.expr("date_add(date'2024-01-01', cast(accession % 28 as int))").alias("day"))
    out = temporal.asof_forward(e, s, ["ticker"], "day", ["base_day", "close", "c1", "c3", "c5"]).where("close > 0")
    return out.select("accession", "base_day", *[F.round(F.col(f"c{n}") / F.col("close") - 1, 6).alias(f"r{n}") for n in (1, 3, 5)])


@query(f"WITH {PRICES} SELECT ticker, day, round(close / lag(close) OVER w - 1, 6) AS ret, round(CASE WHEN count(*) OVER v >= 5 THEN volume / avg(volume) OVER v END, 6) AS volume_ratio FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY day), v AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def volume_ratio(spark, sf):
    """Daily returns, and volume over the mean of the 20 days before (at least five)."""
    w = W.partitionBy("ticker").orderBy("day")
    v = w.rowsBetween(-20, -1)
    ratio = F.when(F.count("*").over(v) >= 5, F.col("volume") / F.avg("volume").over(v))
    return prices(spark, sf).select("ticker", "day", F.round(F.col("close") / F.lag("close").over(w) - 1, 6).alias("ret"), F.round(ratio, 6).alias("volume_ratio"))


@query(f"WITH {PRICES} SELECT ticker, day, round(coalesce(lead(close, 3) OVER w, last_value(close) OVER f) / lag(close) OVER w - 1, 6) AS window_ret FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY day), f AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def event_window_returns(spark, sf):
    """From the close before a day to the third after it, or the last there is."""
    w = W.partitionBy("ticker").orderBy("day")
    end = F.coalesce(F.lead("close", 3).over(w), F.last("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return prices(spark, sf).select("ticker", "day", F.round(end / F.lag("close").over(w) - 1, 6).alias("window_ret"))


SERIES = "s AS (SELECT cik, filed, accession, materiality AS y, row_number() OVER (PARTITION BY cik ORDER BY filed, accession) - 1 AS x, count(*) OVER (PARTITION BY cik) AS n FROM alerts)"


def series(spark, sf):
    w = W.partitionBy("cik")
    return alerts(spark, sf).select("cik", "filed", "accession", F.col("materiality").alias("y"), (F.row_number().over(w.orderBy("filed", "accession")) - 1).alias("x"), F.count("*").over(w).alias("n"))


@query(f"WITH {SERIES}, t AS (SELECT cik, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(y, x) END, 6) + 0.0 AS slope FROM s GROUP BY cik) SELECT cik, n, slope, CASE WHEN slope > 0.5 THEN 'RISING' WHEN slope < -0.5 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM t")
def trend_slope(spark, sf):
    """Least-squares slope of a company's scores over their positions, and its label."""
    out = series(spark, sf).groupBy("cik").agg(F.count("*").alias("n"), (F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.regr_slope("y", "x")), 6) + 0.0).alias("slope"))
    return out.withColumn("trend", scores.trend_label(F.col("slope")))


@query(f"WITH {SERIES}, z AS (SELECT *, avg(y) OVER (PARTITION BY cik) AS mu, stddev_samp(y) OVER (PARTITION BY cik) AS sd FROM s) SELECT accession, round((y - mu) / sd, 4) AS z FROM z WHERE n >= 3 AND sd > 0 AND abs((y - mu) / sd) >= 2.0")
def trend_anomalies(spark, sf):
    """Scores two deviations away from their company's mean. Scores are whole hundredths, so the squares are whole numbers too
    and a score exactly two deviations away is in, in whatever order the rows come."""
    w = W.partitionBy("cik")
    whole = lambda c: c.cast("decimal(20,0)")
    own = alerts(spark, sf).select("cik", "accession", F.round(F.col("materiality") * 100).cast("long").alias("y"))
    own = own.select("accession", "y", F.count("*").over(w).alias("n"), F.sum("y").over(w).alias("s"), F.sum(F.col("y") * F.col("y")).over(w).alias("q")).where("n >= 3")
    # z = (y - s / n) / sqrt((q - s * s / n) / (n - 1)): its square is above / below
    own = own.withColumn("off", F.col("n") * F.col("y") - F.col("s"))
    own = own.withColumn("above", whole(F.col("off")) * whole(F.col("off")) * whole(F.col("n") - 1)).withColumn("below", whole(F.col("n")) * (whole(F.col("n")) * whole(F.col("q")) - whole(F.col("s")) * whole(F.col("s"))))
    z = F.signum(F.col("off").cast("double")) * F.sqrt(F.col("above").cast("double") / F.col("below").cast("double"))
    return own.where("below > 0 and above >= 4 * below").select("accession", F.round(z, 4).alias("z"))


@query(f"WITH {SERIES} SELECT cik, round(avg(y) FILTER (WHERE x >= n // 2) - avg(y) FILTER (WHERE x < n // 2), 6) AS acceleration FROM s WHERE n >= 4 GROUP BY cik")
def trend_acceleration(spark, sf):
    """Mean of the later half less the mean of the earlier."""
    half = F.floor(F.col("n") / 2)
    return series(spark, sf).where("n >= 4").groupBy("cik").agg(F.round(F.avg(F.when(F.col("x") >= half, F.col("y"))) - F.avg(F.when(F.col("x") < half, F.col("y"))), 6).alias("acceleration"))


@query(f"WITH {SERIES} SELECT cik, max_by(y, x) AS latest, min_by(y, x) AS first, max(y) AS peak FROM s GROUP BY cik")
def trend_extremes(spark, sf):
    return series(spark, sf).groupBy("cik").agg(F.max_by("y", "x").alias("latest"), F.min_by("y", "x").alias("first"), F.max("y").alias("peak"))


@query(f"""WITH {SERIES}, t AS (SELECT cik, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(y, x) END, 6) + 0.0 AS slope, avg(y) AS mean FROM s GROUP BY cik)
SELECT c.sector, count(*) AS n, round(avg(t.mean), 4) AS mean, count(*) FILTER (WHERE t.slope > 0.5) AS rising FROM t JOIN companies c ON c.cik = t.cik GROUP BY c.sector""")
def sector_trend_summary(spark, sf):
    own = series(spark, sf).groupBy("cik").agg((F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.regr_slope("y", "x")), 6) + 0.0).alias("slope"), F.avg("y").alias("m"))
    return own.join(companies(spark, sf), "cik").groupBy("sector").agg(F.count("*").alias("n"), F.round(F.avg("m"), 4).alias("mean"), F.count_if(F.col("slope") > 0.5).alias("rising"))


RETURNS = f"{PRICES}, r AS (SELECT ticker, day, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS ret FROM prices), m AS (SELECT day, avg(ret) AS bench FROM r WHERE ret IS NOT NULL GROUP BY day)"


def returns(spark, sf):
    """Daily returns of each entity beside the benchmark, the mean of all of that day."""
    own = prices(spark, sf).select("ticker", "day", (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("day")) - 1).alias("ret")).where("ret is not null")
    return own.join(own.groupBy("day").agg(F.avg("ret").alias("bench")), "day")


@query(f"""WITH {RETURNS}, j AS (SELECT r.ticker, r.day, r.ret, m.bench FROM r JOIN m ON m.day = r.day WHERE r.ret IS NOT NULL), e AS (SELECT DISTINCT ticker, DATE '2024-01-24' AS at FROM j),
fit AS (SELECT e.ticker, e.at, CASE WHEN var_pop(bench) <= 1e-10 THEN 1.0 ELSE regr_slope(ret, bench) END AS beta, CASE WHEN var_pop(bench) <= 1e-10 THEN avg(ret) - avg(bench) ELSE regr_intercept(ret, bench) END AS alpha FROM e JOIN j ON j.ticker = e.ticker AND j.day < e.at - 2 GROUP BY e.ticker, e.at HAVING count(*) >= 15),
w AS (SELECT f.ticker, j.ret - (f.alpha + f.beta * j.bench) AS ab, row_number() OVER (PARTITION BY f.ticker ORDER BY j.day) AS k FROM fit f JOIN j ON j.ticker = f.ticker AND j.day >= f.at)
SELECT f.ticker, round(f.beta, 6) AS beta, round(f.alpha, 6) AS alpha, round((SELECT sum(ab) FROM w WHERE w.ticker = f.ticker AND k <= 4), 6) AS car FROM fit f""")
def event_car_market_model(spark, sf):
    """Market model before an event and the cumulative abnormal return over the first four trading days after."""
    j = returns(spark, sf).withColumn("at", F.lit("2024-01-24").cast("date"))
    flat = F.var_pop("bench") <= 1e-10
    fit = j.where("day < date_sub(at, 2)").groupBy("ticker").agg(F.when(flat, 1.0).otherwise(F.regr_slope("ret", "bench")).alias("beta"), F.when(flat, F.avg("ret") - F.avg("bench")).otherwise(F.regr_intercept("ret", "bench")).alias("alpha"), F.count("*").alias("n")).where("n >= 15")
    after = j.where("day >= at").withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy("day"))).where("k <= 4").join(fit, "ticker")
    car = after.groupBy("ticker").agg(F.sum(F.col("ret") - (F.col("alpha") + F.col("beta") * F.col("bench"))).alias("car"))
    return fit.join(car, "ticker", "left").select("ticker", F.round("beta", 6).alias("beta"), F.round("alpha", 6).alias("alpha"), F.round("car", 6).alias("car"))


DAILY = """p AS (SELECT cik % 5 AS ticker, filed AS day, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) AS close FROM filings GROUP BY 1, 2),
r AS (SELECT ticker, day, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS ret FROM p), m AS (SELECT day, sum(ret) / count(ret) AS bench FROM r WHERE ret IS NOT NULL GROUP BY day),
j AS (SELECT ticker, day, ret, bench FROM r JOIN m USING (day) WHERE ret IS NOT NULL), e AS (SELECT accession, cik % 5 AS ticker, filed AS happened FROM filings WHERE form = '8-K'),
q AS (SELECT accession, count(*) AS days, avg(ret) AS my, avg(bench) AS mx, sum(bench * bench) - sum(bench) * sum(bench) / count(*) AS v, sum(ret * bench) - sum(ret) * sum(bench) / count(*) AS c FROM e JOIN j ON j.ticker = e.ticker AND j.day BETWEEN e.happened - 170 AND e.happened - 10 GROUP BY accession HAVING count(*) >= 20),
f AS (SELECT accession, days, CASE WHEN v > 1e-10 THEN c / v ELSE 1.0 END AS beta, my - CASE WHEN v > 1e-10 THEN c / v ELSE 1.0 END * mx AS alpha FROM q),
w AS (SELECT accession, day - happened AS d, ret - (alpha + beta * bench) AS ab, row_number() OVER (PARTITION BY accession ORDER BY day) AS k FROM f JOIN e USING (accession) JOIN j USING (ticker) WHERE day >= happened AND day <= happened + 15),
cars AS (SELECT accession, sum(ab) FILTER (WHERE k <= 2 AND d <= 6) AS car1, sum(ab) FILTER (WHERE k <= 4 AND d <= 8) AS car3, sum(ab) FILTER (WHERE k <= 6 AND d <= 10) AS car5, sum(ab) FILTER (WHERE k <= 11) AS car10 FROM w GROUP BY accession HAVING count(*) FILTER (WHERE d <= 8) > 0)"""


def event_cars(spark, sf):
    """Market model and abnormal returns of every 8-K on its own date; five entities' daily amounts stand for prices."""
    own = filings(spark, sf)
    price = own.groupBy((F.col("cik") % 5).alias("ticker"), F.col("filed").alias("day")).agg(F.sum(F.round(F.col("amount") * 100).cast("long")).cast("double").alias("close"))
    ret = price.select("ticker", "day", (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("day")) - 1).alias("ret")).where("ret is not null")
    daily = ret.join(ret.groupBy("day").agg((F.sum("ret") / F.count("ret")).alias("bench")), "day")
    events = own.where("form = '8-K'").select("accession", (F.col("cik") % 5).alias("ticker"), "filed")
    return study.market_model(events, daily, "accession", "ticker", "filed", windows={"car3": 3, "car1": 1, "car5": 5, "car10": 10})


@query(f"WITH {DAILY} SELECT accession, days, round(beta, 5) AS beta, round(alpha, 5) AS alpha, round(car1, 5) AS car1, round(car3, 5) AS car3, round(car5, 5) AS car5, round(car10, 5) AS car10 FROM cars JOIN f USING (accession)")
def filing_market_model(spark, sf):
    """Each filing's own market model (170 to 10 days before it) and its abnormal returns over four windows."""
    return event_cars(spark, sf).select("accession", "days", *[F.round(c, 5).alias(c) for c in ("beta", "alpha", "car1", "car3", "car5", "car10")])


@query(f"""WITH {DAILY}, x AS (SELECT ranking, car3, coalesce(nullif(car1, 0), car3) AS car1, coalesce(nullif(car5, 0), car3) AS car5, coalesce(nullif(car10, 0), car3) AS car10 FROM cars JOIN alerts USING (accession))
SELECT ranking, count(*) AS n, round(avg(car3), 5) AS mean_car3, round(avg(car1), 5) AS mean_car1, round(avg(car5), 5) AS mean_car5, round(avg(car10), 5) AS mean_car10, round(avg(CASE WHEN car3 > 0 THEN 1.0 ELSE 0.0 END), 5) AS hit_rate FROM x GROUP BY ranking""")
def filing_event_study(spark, sf):
    """The event study of filings by alert rank, each on its own date."""
    own = event_cars(spark, sf).join(alerts(spark, sf).select("accession", "ranking"), "accession")
    out = study.summary(own, "ranking", "car3", ["car1", "car5", "car10"])
    return out.select("ranking", "n", *[F.round(c, 5).alias(c) for c in out.columns[2:]])


@query("""WITH r AS (SELECT form, row_number() OVER (PARTITION BY form ORDER BY materiality, accession) AS a, row_number() OVER (PARTITION BY form ORDER BY burial, accession) AS b FROM alerts)
SELECT form, count(*) AS n, round(1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1.0)), 6) AS ic FROM r GROUP BY form""")
def spearman_ic(spark, sf):
    """Rank correlation with ties by position. Ranks are counted in three levels, values to a hundredth, then lots of a
    thousand ids of one value, then the rows of a lot, since many scores stand at their cap."""
    own = alerts(spark, sf).select("form", "accession", "materiality", "burial")

    def ranked(rows, value, name):
        w = W.partitionBy("form")
        lots = rows.withColumn("lot", F.expr("accession div 1000"))
        sizes = lots.groupBy("form", value, "lot").agg(F.count("*").alias("c"))
        values = sizes.groupBy("form", value).agg(F.sum("c").alias("v")).select("form", value, (F.sum("v").over(w.orderBy(value)) - F.col("v")).alias("below"))
        before = sizes.withColumn("within", F.sum("c").over(W.partitionBy("form", value).orderBy("lot")) - F.col("c")).join(values, ["form", value]).select("form", value, "lot", (F.col("below") + F.col("within")).alias("before"))
        ranks = lots.withColumn("k", F.row_number().over(W.partitionBy("form", value, "lot").orderBy("accession"))).join(before, ["form", value, "lot"])
        return ranks.withColumn(name, (F.col("before") + F.col("k")).cast("double")).drop("k", "before", "lot")

    r = ranked(ranked(own, "materiality", "a"), "burial", "b")
    n = F.count("*")
    return r.groupBy("form").agg(n.alias("n"), F.round(1 - 6.0 * F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))) / (n * (n.cast("double") * n - 1)), 6).alias("ic"))


@query(f"""WITH {RETURNS}, b AS (SELECT CASE WHEN volume >= 10 THEN 'HIGH' WHEN volume >= 6 THEN 'MID' ELSE 'LOW' END AS bucket, lead(close) OVER (PARTITION BY ticker ORDER BY day) / close - 1 AS f FROM prices WHERE close > 0)
SELECT bucket, count(f) AS n, CASE WHEN count(f) >= 5 THEN round(avg(f), 6) END AS mean, CASE WHEN count(f) >= 5 THEN round(stddev_samp(f), 6) END AS sd, CASE WHEN count(f) >= 5 THEN round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE f IS NOT NULL), 6) END AS hit_rate FROM b GROUP BY bucket""")
def bucket_event_stats(spark, sf):
    """Mean, deviation and hit rate of the next return by bucket; too few events give nulls."""
    w = W.partitionBy("ticker").orderBy("day")
    own = prices(spark, sf).where("close > 0").select(F.when(F.col("volume") >= 10, "HIGH").when(F.col("volume") >= 6, "MID").otherwise("LOW").alias("bucket"), (F.lead("close").over(w) / F.col("close") - 1).alias("f"))
    enough = F.count("f") >= 5
    hit = F.avg(F.when(F.col("f").isNotNull(), F.when(F.col("f") > 0, 1.0).otherwise(0.0)))
    return own.groupBy("bucket").agg(F.count("f").alias("n"), F.when(enough, F.round(F.avg("f"), 6)).alias("mean"), F.when(enough, F.round(F.stddev_samp("f"), 6)).alias("sd"), F.when(enough, F.round(hit, 6)).alias("hit_rate"))


@query(f"WITH {RETURNS} SELECT ticker, count(*) AS n, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252 / 5.0), 6) AS sharpe FROM r WHERE ret IS NOT NULL GROUP BY ticker")
def sharpe_ratio(spark, sf):
    own = returns(spark, sf)
    sd = F.stddev_pop("ret")
    return own.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("ret") / F.when(sd != 0, sd) * F.sqrt(F.lit(252 / 5.0)), 6).alias("sharpe"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(CAST(round(value * 100) AS BIGINT)) / 100, 6) AS mean FROM events GROUP BY 1, 2", with_roles=False)
def events_tumbling_window(spark, sf):
    """Extension: one-day tumbling windows."""
    own = read(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.round(F.col("value") * 100).cast("long")) / 100, 6).alias("mean"))
    return own.select("event_type", F.col("window.start").alias("day"), "n", "mean")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", with_roles=False)
def events_session_window(spark, sf):
    """Extension: sessions that 30 idle minutes end."""
    own = read(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("""WITH RECURSIVE o AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) AS t FROM events WHERE event_type = 'view'),
k AS (SELECT user_id, min(t) AS t FROM o GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(o.t) FROM o WHERE o.user_id = k.user_id AND o.t >= k.t + 21600) FROM k WHERE k.t IS NOT NULL)
SELECT user_id, count(t) AS sent FROM k WHERE t IS NOT NULL GROUP BY user_id""", with_roles=False)
def throttled_alerts(spark, sf):
    """Alerts that a six-hour throttle from the last one sent lets through."""
    return temporal.throttled_counts(read(spark, sf, "events").where("event_type = 'view'"), "user_id", "ts", 21600.0)
