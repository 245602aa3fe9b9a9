"""Lookups and listings, validation, alert payloads, topics, status logs and event-study summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import changes, temporal
from ..sources.tables import read
from .base import registrar
from .roles import alerts, companies, filings, lines
from .temporal import PRICES, RETURNS, prices, returns
from .text import NUM, VERSIONS, versions

QUERIES: dict = {}
query = registrar(QUERIES)

cents = lambda c: F.round(F.col(c) * 100).cast("long")


# -- lookups and listings ---------------------------------------------------------------------------------------------
@query("SELECT accession, cik, form, filed FROM filings WHERE accession = 7")
def filing_by_accession(spark, sf):
    """One filing by its key."""
    return filings(spark, sf).where("accession = 7").select("accession", "cik", "form", "filed")


@query("SELECT accession, flag, seq FROM lines WHERE accession = 7 AND flag <> 'N' ORDER BY flag, seq LIMIT 50")
def changes_of_filing(spark, sf):
    """Changes of one filing but the unchanged ones, in order of item."""
    return lines(spark, sf).where("accession = 7 and flag <> 'N'").orderBy("flag", "seq").limit(50).select("accession", "flag", "seq")


def search_filings(found, texts=None, cik=None, form=None, since=None, until=None, keyword=None):
    """Filings that meet all the conditions given; a keyword is looked for in the joined full text, whatever its case."""
    if cik is not None:
        found = found.where(F.col("cik") == cik)
    if form is not None:
        found = found.where(F.regexp_replace("form", "/A$", "") == form)
    if since is not None:
        found = found.where(F.col("filed") >= F.lit(since).cast("date"))
    if until is not None:
        found = found.where(F.col("filed") <= F.lit(until).cast("date"))
    if keyword is not None:
        found = found.join(texts.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).select("accession"), "accession", "left_semi")
    return found


@query("SELECT f.accession, f.form, f.filed FROM filings f JOIN documents d ON d.doc_id = f.accession WHERE f.form IN ('10-K', '10-K/A') AND f.filed BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND contains(lower(d.text), 'that') ORDER BY f.filed DESC, f.accession DESC LIMIT 100")
def filing_search(spark, sf):
    """Filings by form, dates and a word of their text, newest first."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("accession"), "text")
    found = search_filings(filings(spark, sf), texts, form="10-K", since="1994-01-01", until="1997-12-31", keyword="THAT")
    return found.orderBy(F.desc("filed"), F.desc("accession")).limit(100).select("accession", "form", "filed")


@query("SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup' AND user_id = 7 ORDER BY ts, event_id", with_roles=False)
def active_topics_of_user(spark, sf):
    """Standing topics of one user that are switched on."""
    return read(spark, sf, "events").where("event_type = 'signup' and user_id = 7").orderBy("ts", "event_id").select("user_id", "event_id", "ts")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100", with_roles=False)
def runs_in_order(spark, sf):
    """The first hundred runs as they were entered."""
    return read(spark, sf, "events").orderBy("event_id").limit(100).select("event_id", "event_type")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS position FROM events", with_roles=False)
def run_listing(spark, sf):
    """All runs with the position at which they were entered, counted by ranges of ids."""
    own = read(spark, sf, "events").select("event_id", "event_type", F.expr("event_id div 10000").alias("lot"))
    before = own.groupBy("lot").agg(F.count("*").alias("c"))
    before = before.select("lot", (F.sum("c").over(W.orderBy("lot")) - F.col("c")).alias("before"))  # one row for ten thousand runs
    within = F.row_number().over(W.partitionBy("lot").orderBy("event_id"))
    return own.withColumn("k", within).join(before, "lot").select("event_id", "event_type", (F.col("before") + F.col("k")).alias("position"))


@query("""WITH a AS (SELECT * FROM filings WHERE form = '10-K/A'), o AS (SELECT * FROM filings WHERE form = '10-K'),
x AS (SELECT a.accession, a.filed, o.accession AS original, row_number() OVER (PARTITION BY a.accession ORDER BY o.filed DESC, o.accession DESC) AS k FROM a JOIN o ON o.cik = a.cik AND o.filed <= a.filed)
SELECT original, CAST(1 + row_number() OVER (PARTITION BY original ORDER BY filed, accession) AS BIGINT) AS version, accession, filed FROM x WHERE k = 1""")
def amendment_listing(spark, sf):
    """The amendments of every filing by version."""
    own = filings(spark, sf)
    o = own.where("form = '10-K'").select("cik", "filed", F.col("accession").alias("original"))
    a = temporal.asof_backward(own.where("form = '10-K/A'").select("accession", "cik", "filed"), o, ["cik"], "filed", ["original"])
    return temporal.numbered_of(a.where("original is not null"), "original", ["filed", "accession"], "version").select("original", "version", "accession", "filed").orderBy("original", "version")


@query(None, with_roles=False)
def sliding_log_limit(spark, sf):
    """Calls that a sliding log of one hour and two calls a user lets through; refused calls do not count."""
    return temporal.sliding_log(read(spark, sf, "events"), "event_id", "user_id", "ts", 2, 3600)


@query("SELECT accession, 'https://www.example.org/data/' || cik || '/' || lpad(CAST(accession AS VARCHAR), 18, '0') || '/' AS folder, 'https://www.example.org/data/' || cik || '/' || lpad(CAST(accession AS VARCHAR), 18, '0') || '/form' || accession || '.xml' AS document FROM filings")
def filing_addresses(spark, sf):
    """Folder and raw document of each filing; style-sheet folders are left out of a document's path."""
    folder = F.concat(F.lit("https://www.example.org/data/"), F.col("cik"), F.lit("/"), F.lpad(F.col("accession").cast("string"), 18, "0"), F.lit("/"))
    path = F.concat(F.lit("xslF345X05/form"), F.col("accession"), F.lit(".xml"))
    return filings(spark, sf).select("accession", folder.alias("folder"), F.concat(folder, F.regexp_replace(path, "^xsl[^/]*/", "")).alias("document"))


@query("""WITH w AS (SELECT p_partkey, list_transform(string_split(p_name || ', ' || p_brand || ',' || p_name || ', ' || p_type, ','), lambda x: upper(trim(x))) AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(w[1:i - 1], w[i])), lambda i: w[i]), '|') AS forms FROM w""", with_roles=False)
def form_lists(spark, sf):
    """A comma list in upper case, each entry once at its first place."""
    raw = F.concat_ws(",", F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand")), F.col("p_name"), F.concat(F.lit(" "), F.col("p_type")))
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(F.transform(F.split(raw, ","), lambda x: F.upper(F.trim(x)))), "|").alias("forms"))


@query("SELECT accession, filed FROM filings WHERE filed >= (SELECT max(filed) FROM filings) - 365 * 2")
def filings_of_two_years(spark, sf):
    """Filings of the last twice 365 days."""
    own = filings(spark, sf)
    return own.withColumn("last", own.agg(F.max("filed")).scalar()).where("filed >= date_sub(last, 365 * 2)").select("accession", "filed")


@query("SELECT accession, form FROM filings WHERE starts_with(form, '10-')")
def filings_by_form_prefix(spark, sf):
    return filings(spark, sf).where(F.col("form").startswith("10-")).select("accession", "form")


# -- validation and filters -------------------------------------------------------------------------------------------
@query("""WITH x AS (SELECT f.accession, upper(left(c.segment, 6)) AS ticker, f.form, round(f.amount / 400000.0, 6) AS score, coalesce(n, 0) AS n FROM filings f JOIN companies c ON c.cik = f.cik LEFT JOIN (SELECT accession, sum(words) AS n FROM lines GROUP BY 1) l ON l.accession = f.accession)
SELECT accession, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(ticker, '[A-Z]{1,5}') THEN 'ticker' END, CASE WHEN form NOT IN ('10-K', '10-Q', '8-K', '10-K/A') THEN 'form' END, CASE WHEN score < 0 OR score > 1 THEN 'score range' END], lambda v: v IS NOT NULL), ',') AS errors,
  array_to_string(list_filter([CASE WHEN n < 100 THEN 'short text' END, CASE WHEN n = 0 THEN 'no articles' END], lambda v: v IS NOT NULL), ',') AS warnings FROM x""")
def validation_lists(spark, sf):
    """Errors and warnings of each filing: symbol, form, finite score in range, count and length of text."""
    n = lines(spark, sf).groupBy("accession").agg(F.sum("words").alias("n"))
    own = filings(spark, sf).join(companies(spark, sf).select("cik", F.upper(F.substring("segment", 1, 6)).alias("ticker")), "cik").join(n, "accession", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.round(F.col("amount") / 400000.0, 6)
    errors = [F.when(~F.col("ticker").rlike("^[A-Z]{1,5}$"), "ticker"), F.when(~F.col("form").isin("10-K", "10-Q", "8-K", "10-K/A"), "form"), F.when(F.isnan(score) | (score < 0) | (score > 1), "score range")]
    warnings = [F.when(F.col("n") < 100, "short text"), F.when(F.col("n") == 0, "no articles")]
    return own.select("accession", F.array_join(F.array_compact(F.array(*errors)), ",").alias("errors"), F.array_join(F.array_compact(F.array(*warnings)), ",").alias("warnings"))


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS host FROM pages), t AS (SELECT page_id, CASE WHEN ends_with(host, '.org') THEN 1 WHEN ends_with(host, '.net') THEN 2 ELSE 3 END AS tier, NOT starts_with(host, 'm.') AS valid FROM h)
SELECT page_id, tier AS verified_tier FROM t WHERE valid AND tier <= 2""", with_roles=False)
def verified_articles(spark, sf):
    """Articles of sources that are valid and of tier 2 or better, with the tier."""
    host = F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^www\.", "")
    tier = F.when(F.col("host").endswith(".org"), 1).when(F.col("host").endswith(".net"), 2).otherwise(3)
    return read(spark, sf, "pages").select("page_id", host.alias("host")).select("page_id", tier.alias("verified_tier"), (~F.col("host").startswith("m.")).alias("valid")).where("valid and verified_tier <= 2").select("page_id", "verified_tier")


@query("SELECT conv_id, turn FROM conversations WHERE lower(role) IN ('user', 'bob') OR contains(lower(string_split(text, chr(10))[1]), 'that')", with_roles=False)
def symbol_relevant_articles(spark, sf):
    """Articles tagged with a symbol, whatever its case, or naming it in their title."""
    named = F.contains(F.lower(F.element_at(F.split("text", "\n"), 1)), F.lit("that"))
    return read(spark, sf, "conversations").where(F.lower("role").isin("user", "bob") | named).select("conv_id", "turn")


@query(f"WITH {PRICES}, r AS (SELECT ticker, day, 100 * (close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1) AS pct FROM prices) SELECT ticker, day, round(pct, 4) AS pct FROM r WHERE abs(pct) >= 3")
def material_moves(spark, sf):
    """Days whose close moved by three percent or more."""
    pct = 100 * (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("day")) - 1)
    return prices(spark, sf).select("ticker", "day", pct.alias("pct")).where("abs(pct) >= 3").select("ticker", "day", F.round("pct", 4).alias("pct"))


# -- joins ------------------------------------------------------------------------------------------------------------
@query("""WITH n AS (SELECT cik, filed, accession, form FROM filings QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) = 1), o AS (SELECT accession, flag AS item, sum(words) AS w FROM lines GROUP BY 1, 2),
p AS (SELECT n.accession, max_by(f.accession, (f.filed, f.accession)) AS prior FROM n JOIN filings f ON f.cik = n.cik AND f.form = n.form AND (f.filed, f.accession) < (n.filed, n.accession) GROUP BY 1)
SELECT n.accession, a.item, a.w AS new_words, coalesce(b.w, 0) AS old_words FROM n JOIN o a ON a.accession = n.accession LEFT JOIN p ON p.accession = n.accession LEFT JOIN o b ON b.accession = p.prior AND b.item = a.item""")
def new_items_against_prior(spark, sf):
    """Items of each company's newest filing beside those of the one of like form before it; items that went are ignored."""
    w = W.partitionBy("cik", "form").orderBy("filed", "accession")
    newest = filings(spark, sf).withColumn("prior", F.lag("accession").over(w)).groupBy("cik").agg(F.max_by(F.struct("accession", "prior"), F.struct("filed", "accession")).alias("s")).select("s.*")
    items = lines(spark, sf).groupBy("accession", F.col("flag").alias("item")).agg(F.sum("words").alias("w"))
    old = items.select(F.col("accession").alias("prior"), "item", F.col("w").alias("old"))
    return newest.join(items, "accession").join(old, ["prior", "item"], "left").select("accession", "item", F.col("w").alias("new_words"), F.coalesce("old", F.lit(0)).alias("old_words"))


PERIODS = "d AS (SELECT accession, cik, regexp_replace(form, '/A$', '') AS base, form LIKE '%/A' AS amends, filed, date_trunc('quarter', filed - 40) AS period FROM filings)"


@query(f"""WITH {PERIODS}, x AS (SELECT a.accession, a.filed, o.accession AS original, row_number() OVER (PARTITION BY a.accession ORDER BY o.period = a.period DESC, o.filed DESC, o.accession DESC) AS k
  FROM d a JOIN d o ON o.cik = a.cik AND o.base = a.base AND NOT o.amends AND o.filed < a.filed WHERE a.amends)
SELECT a.accession, x.original, CASE WHEN x.original IS NULL THEN 2 ELSE 1 + row_number() OVER (PARTITION BY x.original ORDER BY a.filed, a.accession) END AS version FROM d a LEFT JOIN x ON x.accession = a.accession AND k = 1 WHERE a.amends""")
def amendments_by_period(spark, sf):
    """Each amendment with the latest earlier original of its base form and report period, else of its base form, and
    its version of it; an amendment without an original is version 2."""
    own = filings(spark, sf).select("accession", "cik", F.regexp_replace("form", "/A$", "").alias("base"), F.col("form").rlike("/A$").alias("amends"), "filed", F.trunc(F.date_sub("filed", 40), "quarter").alias("period"))
    o = own.where("not amends")
    a = temporal.asof_backward(own.where("amends"), o.select("cik", "base", "period", "filed", F.col("accession").alias("same")), ["cik", "base", "period"], "filed", ["same"], strict=True)
    a = temporal.asof_backward(a, o.select("cik", "base", "filed", F.col("accession").alias("other")), ["cik", "base"], "filed", ["other"], strict=True)
    a = a.withColumn("original", F.coalesce("same", "other"))
    return temporal.numbered_of(a, "original", ["filed", "accession"], "version").select("accession", "original", "version")


@query("SELECT a.accession, a.materiality, l.n, l.latest FROM alerts a LEFT JOIN (SELECT accession, count(*) AS n, max(shipped) AS latest FROM lines WHERE status = 'F' GROUP BY 1) l ON l.accession = a.accession")
def feed_with_live_rows(spark, sf):
    """The feed enriched by what is known live about its filings."""
    live = lines(spark, sf).where("status = 'F'").groupBy("accession").agg(F.count("*").alias("n"), F.max("shipped").alias("latest"))
    return alerts(spark, sf).select("accession", "materiality").join(live, "accession", "left")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY cik, form IN ('10-K', '10-Q') ORDER BY filed DESC, accession DESC) AS k FROM filings) SELECT accession, cik, form IN ('10-K', '10-Q') AND k = 1 AS current FROM f")
def current_filing_flags(spark, sf):
    """The newest periodic filing of each company is flagged as the current one."""
    periodic = F.col("form").isin("10-K", "10-Q")
    k = F.row_number().over(W.partitionBy("cik", periodic).orderBy(F.desc("filed"), F.desc("accession")))
    return filings(spark, sf).select("accession", "cik", (periodic & (k == 1)).alias("current"))


@query("""WITH c AS (SELECT cik, name FROM companies), e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS cik, 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name FROM events)
SELECT e.event_id, coalesce(a.cik, b.cik) AS cik FROM e LEFT JOIN c a ON a.cik = e.cik LEFT JOIN c b ON lower(b.name) = e.name""")
def company_by_key_or_name(spark, sf):
    """Entries resolved by their key, else by the company's name."""
    c = companies(spark, sf)
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("k"), F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("n"))
    by_key, by_name = c.select(F.col("cik").alias("k"), F.col("cik").alias("c1")), c.groupBy(F.lower("name").alias("n")).agg(F.min("cik").alias("c2"))
    return e.join(by_key, "k", "left").join(by_name, "n", "left").select("event_id", F.coalesce("c1", "c2").alias("cik"))


# -- aggregates -------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT CASE WHEN c.balance < 0 THEN 'Unknown' ELSE c.sector END AS sector, CAST(round(a.materiality * 100) AS BIGINT) AS m FROM alerts a JOIN companies c ON c.cik = a.cik)
SELECT sector, count(*) AS n, CAST(min(m) AS BIGINT) AS low, CAST(max(m) AS BIGINT) AS high, round(avg(m) / 100, 3) AS mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(m) END / 100, 3) AS sd FROM s GROUP BY sector""")
def sector_stats_unknown(spark, sf):
    """Sector statistics; companies without a sector count as Unknown, a single one deviates by 0."""
    sector = F.coalesce(F.when(F.col("balance") >= 0, F.col("sector")), F.lit("Unknown"))
    own = alerts(spark, sf).join(companies(spark, sf), "cik").select(sector.alias("sector"), cents("materiality").alias("m"))
    return own.groupBy("sector").agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high"), F.round(F.avg("m") / 100, 3).alias("mean"), F.round(F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("m")) / 100, 3).alias("sd"))


@query("""WITH s AS (SELECT c.sector, avg(CAST(round(a.materiality * 100) AS BIGINT)) AS m FROM alerts a JOIN companies c ON c.cik = a.cik GROUP BY 1)
SELECT round((SELECT sum(m) FROM (SELECT m FROM s ORDER BY sector)) / (SELECT count(*) FROM s) / 100, 4) AS overall, (SELECT sector FROM s ORDER BY m DESC, sector LIMIT 1) AS hottest, (SELECT sector FROM s ORDER BY m, sector LIMIT 1) AS coldest""")
def heatmap_overall(spark, sf):
    """Mean of the sectors' means, the hottest and the coldest sector, the first by name of equal ones."""
    own = alerts(spark, sf).join(companies(spark, sf), "cik").groupBy("sector").agg(F.avg(cents("materiality")).alias("m"))
    return own.agg(F.round(F.avg("m") / 100, 4).alias("overall"), F.min_by("sector", F.struct(-F.col("m"), F.col("sector"))).alias("hottest"), F.min_by("sector", F.struct("m", "sector")).alias("coldest"))


@query("SELECT ranking, count(*) AS n, round(avg(CAST(round(gap * 100) AS BIGINT)) / 100, 3) AS mean_gap, array_to_string(list(accession ORDER BY gap DESC, accession)[1:10], ',') AS top FROM alerts GROUP BY ranking")
def snapshot_by_rank(spark, sf):
    """Alerts by rank: number, mean gap, and the ten with the widest gaps."""
    own = alerts(spark, sf)
    k = F.row_number().over(W.partitionBy("ranking").orderBy(F.desc("gap"), "accession"))
    top = own.select("ranking", "accession", "gap", k.alias("k")).where("k <= 10").groupBy("ranking").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "accession"))), lambda x: x["accession"].cast("string")), ",").alias("top"))
    return own.groupBy("ranking").agg(F.count("*").alias("n"), F.round(F.avg(cents("gap")) / 100, 3).alias("mean_gap")).join(top, "ranking")


@query("""WITH s AS (SELECT accession, flag, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS ratio, CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 2 ELSE 1 END AS w FROM lines GROUP BY 1, 2)
SELECT f.accession, round(coalesce(least(x.m, 0.99), CASE f.form WHEN '10-K' THEN 0.5 WHEN '10-Q' THEN 0.4 ELSE 0.3 END), 6) AS materiality FROM filings f LEFT JOIN (SELECT accession, sum(ratio * w) / sum(w) AS m FROM s GROUP BY 1) x ON x.accession = f.accession""")
def feed_materiality(spark, sf):
    """Weighted mean of the sections' change ratios, at most .99; a default by form where nothing was compared."""
    own = lines(spark, sf).groupBy("accession", "flag").agg((F.count_if(F.col("status") == "O") / F.count("*")).alias("ratio")).withColumn("w", F.when(F.col("flag").isin("R", "A"), 2).otherwise(1))
    own = own.groupBy("accession").agg((F.sum(F.col("ratio") * F.col("w")) / F.sum("w")).alias("m"))
    default = F.when(F.col("form") == "10-K", 0.5).when(F.col("form") == "10-Q", 0.4).otherwise(0.3)
    return filings(spark, sf).join(own, "accession", "left").select("accession", F.round(F.coalesce(F.least("m", F.lit(0.99)), default), 6).alias("materiality"))


@query("SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, min(page_id) AS oldest, round(100.0 * count(*) FILTER (WHERE url LIKE '%?%') / count(*), 1) AS hit_rate FROM pages", with_roles=False)
def cache_stats(spark, sf):
    """Files, bytes, the oldest file and the hit rate of a document cache."""
    return read(spark, sf, "pages").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).cast("long").alias("bytes"), F.min("page_id").alias("oldest"), F.round(100.0 * F.count_if(F.col("url").contains("?")) / F.count("*"), 1).alias("hit_rate"))


@query("""WITH k AS (SELECT unnest(['with', 'rewh', 'orre', 'zzz']) AS word), e AS (SELECT conv_id, lower(string_split(text, chr(10))[1]) AS h FROM conversations)
SELECT word, count(*) FILTER (WHERE contains(h, word)) AS hits, round(count(*) FILTER (WHERE contains(h, word)) / count(*)::DOUBLE, 6) AS rate FROM k CROSS JOIN e GROUP BY word ORDER BY rate DESC, word""", with_roles=False)
def keyword_hit_rates(spark, sf):
    """How many headlines each keyword hits; the few words unfold inside each row and are counted before any shuffle."""
    words = F.array(*[F.lit(x) for x in ("with", "rewh", "orre", "zzz")])
    h = F.lower(F.element_at(F.split("text", "\n"), 1))
    own = read(spark, sf, "conversations").select(h.alias("h")).select("h", F.explode(words).alias("word"))
    hits = F.count_if(F.contains(F.col("h"), F.col("word")))
    return own.groupBy("word").agg(hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("rate")).orderBy(F.desc("rate"), "word")


# -- top-k and order --------------------------------------------------------------------------------------------------
@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY words DESC, seq) AS a, row_number() OVER (PARTITION BY accession ORDER BY disc DESC, seq) AS b FROM lines)
SELECT accession, 'longest' AS kind, a AS place, seq FROM l WHERE a <= 3 UNION ALL SELECT accession, 'reworded', b, seq FROM l WHERE b <= 3""")
def change_samples(spark, sf):
    """Three samples of the longest and three of the most reworded changes of each filing, from one pass."""
    w = W.partitionBy("accession")
    own = lines(spark, sf).select("accession", "seq", F.row_number().over(w.orderBy(F.desc("words"), "seq")).alias("a"), F.row_number().over(w.orderBy(F.desc("disc"), "seq")).alias("b")).where("a <= 3 or b <= 3")
    kinds = F.array(F.struct(F.lit("longest").alias("kind"), F.col("a").alias("place")), F.struct(F.lit("reworded").alias("kind"), F.col("b").alias("place")))
    return own.select("accession", "seq", F.inline(kinds)).where("place <= 3").select("accession", "kind", "place", "seq")


@query("""WITH b AS (SELECT event_type AS signal, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM events GROUP BY 1)
SELECT signal, n, hit_rate, CASE WHEN hit_rate >= 0.6 THEN 'raise' WHEN hit_rate <= 0.4 THEN 'lower' ELSE 'keep' END AS advice FROM b ORDER BY hit_rate DESC, signal""", with_roles=False)
def recommendations(spark, sf):
    """What a backtest advises for each signal, best first."""
    own = read(spark, sf, "events").groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("hit_rate"))
    return own.withColumn("advice", F.when(F.col("hit_rate") >= 0.6, "raise").when(F.col("hit_rate") <= 0.4, "lower").otherwise("keep")).orderBy(F.desc("hit_rate"), "signal")


@query("""WITH a AS (SELECT 0 AS slice, row_number() OVER (ORDER BY gap DESC, accession) AS place, accession FROM alerts ORDER BY place LIMIT 5), b AS (SELECT 1, row_number() OVER (ORDER BY filed DESC, accession DESC) AS place, accession FROM filings ORDER BY place LIMIT 5)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def slices_in_order(spark, sf):
    """The five widest gaps, then the five newest filings, in that order."""
    slices = [alerts(spark, sf).orderBy(F.desc("gap"), "accession").limit(5), filings(spark, sf).orderBy(F.desc("filed"), F.desc("accession")).limit(5)]
    keys = [F.struct(-F.col("gap"), F.col("accession")), F.struct(-F.unix_date("filed"), -F.col("accession"))]
    own = [x.select(F.lit(i).alias("slice"), F.row_number().over(W.partitionBy(F.lit(i)).orderBy(k)).alias("place"), "accession") for i, (x, k) in enumerate(zip(slices, keys))]  # five rows each
    return own[0].unionByName(own[1])


# -- changes of tables ------------------------------------------------------------------------------------------------
@query("SELECT accession, cik, filed, CASE WHEN form = '10-K/A' THEN 2 ELSE 1 END AS version FROM filings")
def upsert_versions_only(spark, sf):
    """A second crawl changes the version of known filings and nothing else of them."""
    own = filings(spark, sf).select("accession", "cik", "filed", F.lit(1).alias("version"))
    new = filings(spark, sf).where("form = '10-K/A'").select("accession", F.lit(None).cast("long").alias("cik"), F.lit(None).cast("date").alias("filed"), F.lit(2).alias("version"))
    return changes.upsert(own, new, ["accession"], keep=["cik", "filed"])


@query("SELECT user_id, event_type AS status, ts AS since, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1", with_roles=False)
def latest_status(spark, sf):
    """The state of each key after a log of status updates, with the number of updates."""
    own = read(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("s"), F.count("*").alias("n"))
    return own.select("user_id", F.col("s.event_type").alias("status"), F.col("s.ts").alias("since"), "n")


@query("""SELECT event_id, '{"by":{"tags":["a",null],"user":' || user_id || '},"k":' || json_extract_string(props, '$.k') || ',"label":"' || event_type || '"}' AS props FROM events""", with_roles=False)
def json_label_set(spark, sf):
    """A JSON document with one path set, the other ones kept."""
    more = F.concat(F.lit(',"label":"old","by":{"user":'), F.col("user_id"), F.lit(',"tags":["a",null]}}'))
    own = read(spark, sf, "events").select("event_id", "event_type", F.concat(F.regexp_replace("props", r"\}\s*$", ""), more).alias("props"))
    return own.select("event_id", changes.json_set(F.col("props"), "label", F.col("event_type")).alias("props"))


# -- text -------------------------------------------------------------------------------------------------------------
# How a filing names the end of its year or period, in order.
YEAR_ENDS = (r"(?i)fiscal year ended?\s+([A-Za-z]+ \d+,\s*\d{4})", r"(?i)year ended?\s+([A-Za-z]+ \d+,\s*\d{4})", r"(?i)period ended?\s+([A-Za-z]+ \d+,\s*\d{4})")


@query("""WITH t AS (SELECT doc_id, left(CASE doc_id % 3 WHEN 0 THEN 'For the fiscal year ended December ' || (1 + doc_id % 28) || ', 2024. ' WHEN 1 THEN 'for the quarterly period ended June 30,  2025 ' ELSE '' END || coalesce(text, ''), 5000) AS t FROM documents)
SELECT doc_id, trim(CASE WHEN regexp_matches(t, 'fiscal year ended?\\s+[A-Za-z]+ \\d+,\\s*\\d{4}', 'i') THEN regexp_extract(t, 'fiscal year ended?\\s+([A-Za-z]+ \\d+,\\s*\\d{4})', 1, 'i') WHEN regexp_matches(t, 'year ended?\\s+[A-Za-z]+ \\d+,\\s*\\d{4}', 'i') THEN regexp_extract(t, 'year ended?\\s+([A-Za-z]+ \\d+,\\s*\\d{4})', 1, 'i')
  ELSE regexp_extract(t, 'period ended?\\s+([A-Za-z]+ \\d+,\\s*\\d{4})', 1, 'i') END) AS year_end FROM t""", with_roles=False)
def fiscal_year_ends(spark, sf):
    """The end of the fiscal year or period that the opening of a filing names (the first 5,000 characters are the feature)."""
    lead = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("For the fiscal year ended December "), 1 + F.col("doc_id") % 28, F.lit(", 2024. "))).when(F.col("doc_id") % 3 == 1, "for the quarterly period ended June 30,  2025 ").otherwise("")
    t = F.substring(F.concat(lead, F.coalesce("text", F.lit(""))), 1, 5000)
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in YEAR_ENDS]
    return read(spark, sf, "documents").select("doc_id", F.trim(F.coalesce(*found, F.lit(""))).alias("year_end"))


# Patterns of sums, shares, dates and names; sums may be told in words, dates by the month's name.
SPECIFICS = {"dollars": r"\$\s?[0-9][0-9,.]*(?:\s?(?:thousand|million|billion|trillion))?", "percents": r"[0-9]+(?:\.[0-9]+)?\s?(?:%|percent)",
             "dates": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s[0-9]{1,2},\s[0-9]{4}", "entities": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(t, '{p}')) AS BIGINT) AS {k}" for k, p in SPECIFICS.items()) + " FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' On March 3, 2024 sales of $ 5 million rose 4 percent.' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)", with_roles=False)
def specifics(spark, sf):
    """How specific a text is: sums, percentages, dates and runs of capitalised words."""
    told = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " On March 3, 2024 sales of $ 5 million rose 4 percent.").otherwise(""))
    own = read(spark, sf, "documents").where("text is not null").select("doc_id", told.alias("t"))
    return own.select("doc_id", *[F.regexp_count("t", F.lit(p)).cast("long").alias(k) for k, p in SPECIFICS.items()])


# Patterns of red flags bound to the invented prose of the tables, with their weights.
FLAGS = {"bankruptcy": (("rewh", "going concern"), 0.98), "fraud": (("orre", r"restat\w+"), 0.95), "litigation": (("thatin", "lawsuits?"), 0.80), "cybersecurity": (("ndedre", "data breach"), 0.78), "impairment": (("shtion", "write-?down"), 0.72), "liquidity": (("with the", "covenant"), 0.70), "leadership": (("was in", "resign(?:s|ed)?"), 0.60)}
FLAG_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, text, '{'|'.join(p)}' AS p FROM documents" for k, (p, _) in FLAGS.items())


@query(f"""WITH f AS ({FLAG_SQL}), s AS (SELECT doc_id, category, regexp_extract_all(lower(text), p) AS m, [substr(lower(text), greatest(1, instr(lower(text), regexp_extract(lower(text), p)) - 50), least(50, instr(lower(text), regexp_extract(lower(text), p)) - 1) + 200)] AS x FROM f WHERE regexp_matches(lower(text), p))
SELECT doc_id, category, len(m) AS hits, x[1] AS excerpt FROM s""", with_roles=False)
def red_flag_excerpts(spark, sf):
    """All hits of a category's patterns and where the first one stands, from 50 characters before it to 200 from its start."""
    low = F.lower("text")
    rows = []
    for k, (patterns, _) in FLAGS.items():
        p = F.lit("|".join(patterns))
        at = F.regexp_instr(low, p)
        rows.append(F.struct(F.lit(k).alias("category"), F.regexp_count(low, p).cast("long").alias("hits"), F.substring(low, F.greatest(at - 50, F.lit(1)), F.least(F.lit(50), at - 1) + 200).alias("excerpt")))
    return read(spark, sf, "documents").select("doc_id", F.inline(F.filter(F.array(*rows), lambda x: x["hits"] > 0)))


#: Families of goods by words of the parts' own names, in order.
INDUSTRIES = {"fasteners": ("bolt", "ring"), "stock": ("rod", "plate"), "tools": ("anvil",), "devices": ("widget", "gizmo")}


@query("""WITH t AS (SELECT p_partkey, upper(left(p_brand, 1)) || 'X ' || p_name || ' ' || p_type AS topic FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split_regex(topic, '[^A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Z]{1,5}')), ',') AS tickers, CASE """ + " ".join(f"WHEN regexp_matches(lower(topic), '{'|'.join(w)}') THEN '{k}'" for k, w in INDUSTRIES.items()) + " ELSE 'general' END AS industry FROM t", with_roles=False)
def topic_symbols(spark, sf):
    """Words of a topic that look like symbols, and the first industry that it touches."""
    topic = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lit("X "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    industry = F.lit("general")
    for k, words in reversed(INDUSTRIES.items()):
        industry = F.when(F.lower("topic").rlike("|".join(words)), k).otherwise(industry)
    return read(spark, sf, "part").select("p_partkey", topic.alias("topic")).select("p_partkey", F.array_join(F.regexp_extract_all("topic", F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1)), ",").alias("tickers"), industry.alias("industry"))


@query("""WITH w AS (SELECT c_custkey, list_transform(string_split(upper(c_mktsegment) || ' OF INC ' || c_name, ' '), lambda x: CASE WHEN x IN ('INC', 'LLC', 'USA') THEN x WHEN x = 'OF' THEN 'of' ELSE upper(left(x, 1)) || lower(substr(x, 2)) END) AS w FROM customer)
SELECT c_custkey, array_to_string(w, ' ') AS name FROM w""", with_roles=False)
def company_title_case(spark, sf):
    """Registered names in title case; abbreviations and short words keep their own."""
    words = F.split(F.concat(F.upper("c_mktsegment"), F.lit(" OF INC "), F.col("c_name")), " ")
    own = F.transform(words, lambda x: F.when(x.isin("INC", "LLC", "USA"), x).when(x == "OF", "of").otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))))
    return read(spark, sf, "customer").select("c_custkey", F.array_join(own, " ").alias("name"))


@query("""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ps FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, list_reduce(list_prepend('', ps), lambda a, x: CASE WHEN len(list_filter(string_split(trim(regexp_extract(a, '[^\\x01]*$') || ' ' || x), ' '), lambda w: w <> '')) >= 15 THEN regexp_replace(a, '[^\\x01]*$', '') || trim(regexp_extract(a, '[^\\x01]*$') || ' ' || x) || chr(1)
  ELSE regexp_replace(a, '[^\\x01]*$', '') || trim(regexp_extract(a, '[^\\x01]*$') || ' ' || x) END) AS s FROM p)
SELECT doc_id, array_to_string(list_filter(string_split(s, chr(1)), lambda x: x <> ''), '|') AS merged FROM m""", with_roles=False)
def merged_short_paragraphs(spark, sf):
    """Lines of fewer than fifteen words run into the next ones."""
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(T.merged_paragraphs(F.col("text"), 15, r"\n"), "|").alias("merged"))


# -- scores and payloads ----------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT accession, flag AS item, round(sum(disc) * 10.0 / count(*), 1) AS score FROM lines GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY score DESC, item) AS k FROM s WHERE score > 0)
SELECT a.accession, a.materiality, a.burial, a.ranking, coalesce(t.items, '[]') AS summary FROM alerts a LEFT JOIN (SELECT accession, '[' || string_agg('{"item":"' || item || '","score":' || score || '}', ',' ORDER BY k) || ']' AS items FROM k WHERE k <= 3 GROUP BY 1) t ON t.accession = a.accession""")
def assembled_alerts(spark, sf):
    """Alerts with their three highest sections as JSON."""
    own = lines(spark, sf).groupBy("accession", F.col("flag").alias("item")).agg(F.round(F.sum("disc") * 10.0 / F.count("*"), 1).alias("score")).where("score > 0")
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "item", "score")))  # a row a section
    top = own.groupBy("accession").agg(F.to_json(F.transform(F.slice(items, 1, 3), lambda x: F.struct(x["item"].alias("item"), x["score"].alias("score")))).alias("summary"))
    return alerts(spark, sf).join(top, "accession", "left").select("accession", "materiality", "burial", "ranking", F.coalesce("summary", F.lit("[]")).alias("summary"))


# Multipliers of words in a headline, bound to the invented prose.
BOOSTS = {"rewh": 2.0, "orre": 1.8, "thatin": 1.6, "with": 1.5, "that": 1.4}


@query("SELECT conv_id, turn, greatest(1.0, " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v} ELSE 1.0 END" for k, v in BOOSTS.items()) + ") AS boost, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in BOOSTS) + ") AS matched FROM conversations WHERE text IS NOT NULL", with_roles=False)
def keyword_boosts(spark, sf):
    """The largest multiplier among the words that a text holds, 1 at least, and the words."""
    found = [(k, v, F.contains(F.lower("text"), F.lit(k))) for k, v in BOOSTS.items()]
    return read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.greatest(F.lit(1.0), *[F.when(c, v).otherwise(1.0) for _, v, c in found]).alias("boost"), F.concat_ws(",", *[F.when(c, k) for k, _, c in found]).alias("matched"))


@query("""WITH m AS (SELECT doc_id, [CASE WHEN contains(lower(text), 'with') THEN 0.6 END, CASE WHEN contains(lower(text), 'rewh') THEN 0.9 END, CASE WHEN contains(lower(text), 'that') THEN 0.5 END] AS s FROM documents)
SELECT doc_id, CASE WHEN list_count(s) = 0 THEN 0.0 ELSE round(least(list_max(s) + least(list_count(s) * 0.05, 0.2), 1.0), 4) END AS relevance FROM m WHERE s IS NOT NULL""", with_roles=False)
def topic_relevance(spark, sf):
    """The best score of the standing topics that a text meets, and a bonus for meeting several."""
    low = F.lower(F.coalesce("text", F.lit("")))
    s = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), v) for k, v in (("with", 0.6), ("rewh", 0.9), ("that", 0.5))]))
    n = F.size(s)
    return read(spark, sf, "documents").select("doc_id", F.when(n == 0, 0.0).otherwise(F.round(F.least(F.array_max(s) + F.least(n * 0.05, F.lit(0.2)), F.lit(1.0)), 4)).alias("relevance"))


ITEMS = "i AS (SELECT f.accession, f.cik, f.form, f.filed, sum(l.words) AS w, count(DISTINCT l.flag) AS secs, count(DISTINCT CASE WHEN l.status = 'O' THEN l.flag END) AS changed, count(*) FILTER (WHERE l.disc >= 8) AS kw FROM filings f JOIN lines l ON l.accession = f.accession GROUP BY ALL)"


def _diffs(spark, sf):
    """Each filing's sections, words and keyword hits beside the words of the one before it."""
    own = lines(spark, sf).groupBy("accession").agg(F.sum("words").alias("w"), F.countDistinct("flag").alias("secs"), F.countDistinct(F.when(F.col("status") == "O", F.col("flag"))).alias("changed"), F.count_if(F.col("disc") >= 8).alias("kw"))
    own = own.join(filings(spark, sf), "accession").withColumn("o", F.lag("w").over(W.partitionBy("cik", "form").orderBy("filed", "accession"))).where("o is not null")
    m = 0.4 * F.least(F.col("kw") / 5.0, F.lit(1.0)) + 0.3 * (F.col("changed") / F.col("secs")) + 0.3 * F.least(F.abs(F.col("w") - F.col("o")) / F.col("o"), F.lit(1.0))
    return own.withColumn("materiality", F.round(m, 6))


@query(f"WITH {ITEMS}, p AS (SELECT *, lag(w) OVER (PARTITION BY cik, form ORDER BY filed, accession) AS o FROM i) SELECT accession, round(0.4 * least(kw / 5.0::DOUBLE, 1.0) + 0.3 * (changed / secs::DOUBLE) + 0.3 * least(abs(w - o) / o::DOUBLE, 1.0), 6) AS materiality FROM p WHERE o IS NOT NULL")
def diff_materiality(spark, sf):
    """Keyword hits, the share of changed sections and the change in volume, blended."""
    return _diffs(spark, sf).select("accession", "materiality")


@query(f"""WITH {ITEMS}, p AS (SELECT *, lag(w) OVER (PARTITION BY cik, form ORDER BY filed, accession) AS o FROM i), m AS (SELECT accession, w, o, round(0.4 * least(kw / 5.0::DOUBLE, 1.0) + 0.3 * (changed / secs::DOUBLE) + 0.3 * least(abs(w - o) / o::DOUBLE, 1.0), 6) AS m FROM p WHERE o IS NOT NULL)
SELECT accession, round(m * 100, 4) AS percent, CASE WHEN m >= 0.8 THEN 'CRITICAL' WHEN m >= 0.6 THEN 'HIGH' WHEN m >= 0.4 THEN 'MEDIUM' WHEN m >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS label, floor(least(100.0, m * 100 / greatest(least(w, o) / greatest(w, o)::DOUBLE, 0.01)) * 100 + 1e-6) / 100 AS gap, round((1 - least(w, o) / greatest(w, o)::DOUBLE) * 100, 3) AS burial FROM m""")
def alert_payloads(spark, sf):
    """Percent, label, gap against coverage and burial of a comparison, as an alert carries them."""
    near = F.least("w", "o") / F.greatest("w", "o")
    m = F.col("materiality")
    label = F.when(m >= 0.8, "CRITICAL").when(m >= 0.6, "HIGH").when(m >= 0.4, "MEDIUM").when(m >= 0.2, "LOW").otherwise("MINIMAL")
    return _diffs(spark, sf).select("accession", F.round(m * 100, 4).alias("percent"), label.alias("label"), (F.floor(F.least(F.lit(100.0), m * 100 / F.greatest(near, F.lit(0.01))) * 100 + 1e-6) / 100).alias("gap"), F.round((1 - near) * 100, 3).alias("burial"))


@query("SELECT accession, seq, flag = 'R' OR disc < 6 AS material FROM lines")
def material_changes(spark, sf):
    """Changes that hold keywords or are unlike their former wording."""
    return lines(spark, sf).select("accession", "seq", ((F.col("flag") == "R") | (F.col("disc") < 6)).alias("material"))


@query("SELECT event_id, round(1 / (1 + exp(-3 * ((value - 50) / 100) / (2 * 0.72))), 6) AS quality, CASE WHEN 1 / (1 + exp(-3 * ((value - 50) / 100) / (2 * 0.72))) < 0.4 THEN 'BEARISH' WHEN 1 / (1 + exp(-3 * ((value - 50) / 100) / (2 * 0.72))) > 0.6 THEN 'BULLISH' ELSE 'NEUTRAL' END AS headline_label, CASE WHEN 1 / (1 + exp(3 * ((value - 50) / 100) / (2 * 0.72))) > 0.55 THEN 'BEARISH' WHEN 1 / (1 + exp(3 * ((value - 50) / 100) / (2 * 0.72))) < 0.45 THEN 'BULLISH' ELSE 'NEUTRAL' END AS article_label FROM events", with_roles=False)
def quality_labels(spark, sf):
    """Labels of headline quality and of article quality, whose poles are opposite."""
    raw = (F.col("value") - 50) / 100
    q, a = scores.headline_quality(raw, F.lit(2)), scores.article_quality(raw, F.lit(2), F.lit(0.72))
    return read(spark, sf, "events").select("event_id", F.round(q, 6).alias("quality"), F.when(q < 0.4, "BEARISH").when(q > 0.6, "BULLISH").otherwise("NEUTRAL").alias("headline_label"), F.when(a > 0.55, "BEARISH").when(a < 0.45, "BULLISH").otherwise("NEUTRAL").alias("article_label"))


# -- event study ------------------------------------------------------------------------------------------------------
@query(f"""WITH {RETURNS}, j AS (SELECT r.ticker, r.day, r.ret - m.bench AS ab FROM r JOIN m ON m.day = r.day WHERE r.ret IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS k FROM j WHERE day >= DATE '2024-01-10'),
c AS (SELECT ticker, ticker % 3 AS rank, sum(ab) FILTER (WHERE k <= 1) AS c1, sum(ab) FILTER (WHERE k <= 3) AS c3, CASE WHEN count(*) >= 5 THEN sum(ab) FILTER (WHERE k <= 5) END AS c5, CASE WHEN count(*) >= 10 THEN sum(ab) FILTER (WHERE k <= 10) END AS c10 FROM k GROUP BY ticker HAVING count(*) >= 3)
SELECT rank, count(*) AS n, round(avg(coalesce(c1, c3)), 6) AS car1, round(avg(c3), 6) AS car3, round(avg(coalesce(c5, c3)), 6) AS car5, round(avg(coalesce(c10, c3)), 6) AS car10, round(avg(CASE WHEN c3 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM c GROUP BY rank""")
def event_study_by_rank(spark, sf):
    """Cumulative abnormal returns at 1, 3, 5 and 10 days by rank; horizons without data fall back to three days."""
    k = F.row_number().over(W.partitionBy("ticker").orderBy("day"))
    own = returns(spark, sf).where("day >= date'2024-01-10'").select("ticker", "day", (F.col("ret") - F.col("bench")).alias("ab"), k.alias("k"))
    upto = lambda n: F.sum(F.when(F.col("k") <= n, F.col("ab")))
    enough = lambda n: F.when(F.count("*") >= n, upto(n))
    c = own.groupBy("ticker").agg(upto(1).alias("c1"), upto(3).alias("c3"), enough(5).alias("c5"), enough(10).alias("c10"), F.count("*").alias("m")).where("m >= 3")
    mean = lambda n: F.round(F.avg(F.coalesce(f"c{n}", "c3")), 6).alias(f"car{n}")
    return c.groupBy((F.col("ticker") % 3).alias("rank")).agg(F.count("*").alias("n"), mean(1), mean(3), mean(5), mean(10), F.round(F.avg(F.when(F.col("c3") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query(f"""WITH {PRICES}, s AS (SELECT CASE WHEN volume >= 10 THEN 'HIGH' WHEN volume >= 6 THEN 'MID' ELSE 'LOW' END AS bucket, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 3) OVER w / close - 1 AS f3, lead(close, 5) OVER w / close - 1 AS f5 FROM prices WHERE close > 0 WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT bucket, count(*) AS n, round(avg(f1), 6) AS mean1, round(avg(f3), 6) AS mean3, round(avg(f5), 6) AS mean5, round(CASE WHEN count(f5) >= 2 THEN avg(f5) / nullif(stddev_samp(f5), 0) END, 6) AS sharpe FROM s GROUP BY bucket""")
def bucket_horizons(spark, sf):
    """Mean returns of a bucket at three horizons, missing ones skipped, and mean over deviation at the longest."""
    w = W.partitionBy("ticker").orderBy("day")
    own = prices(spark, sf).where("close > 0").select(F.when(F.col("volume") >= 10, "HIGH").when(F.col("volume") >= 6, "MID").otherwise("LOW").alias("bucket"), *[(F.lead("close", n).over(w) / F.col("close") - 1).alias(f"f{n}") for n in (1, 3, 5)])
    sd = F.stddev_samp("f5")
    return own.groupBy("bucket").agg(F.count("*").alias("n"), *[F.round(F.avg(f"f{n}"), 6).alias(f"mean{n}") for n in (1, 3, 5)], F.round(F.when((F.count("f5") >= 2) & (sd != 0), F.avg("f5") / sd), 6).alias("sharpe"))


@query(f"WITH {RETURNS} SELECT r.ticker, r.day, round(r.ret - m.bench, 6) AS abnormal FROM r JOIN m ON m.day = r.day WHERE r.ret IS NOT NULL")
def abnormal_returns(spark, sf):
    """Daily returns less the benchmark's."""
    return returns(spark, sf).select("ticker", "day", F.round(F.col("ret") - F.col("bench"), 6).alias("abnormal"))


# -- state ------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, ts + INTERVAL (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 ELSE 30 END) DAY > (SELECT max(ts) FROM events) AS fresh FROM events", with_roles=False)
def cache_freshness(spark, sf):
    """Whether a cached entry is still within the time its kind may live."""
    own = read(spark, sf, "events")
    days = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 7).otherwise(30)
    return own.withColumn("now", own.agg(F.max("ts")).scalar()).select("event_id", (F.col("ts") + F.make_interval(days=days) > F.col("now")).alias("fresh"))


@query("SELECT user_id, event_type AS topic, count(*) AS fired, min(ts) AS first_fired, max(ts) AS last_fired FROM events WHERE value >= 60 GROUP BY 1, 2", with_roles=False)
def topic_firings(spark, sf):
    """History of each topic's firings: how often, first and last."""
    return read(spark, sf, "events").where("value >= 60").groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count("*").alias("fired"), F.min("ts").alias("first_fired"), F.max("ts").alias("last_fired"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM events", with_roles=False)
def sliding_limit(spark, sf):
    """Calls that a sliding log of one hour and two calls a user lets through, every call counted."""
    recent = W.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)
    return read(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", (F.count("*").over(recent) <= 2).alias("allowed"))


@query("SELECT a.accession, a.materiality, coalesce(l.n, 0) AS enriched FROM alerts a LEFT JOIN (SELECT accession, count(*) AS n FROM lines WHERE flag = 'A' GROUP BY 1) l ON l.accession = a.accession")
def enriched_by_id(spark, sf):
    """Alerts whose enrichment arrives later, by key; what has none stays as it was."""
    old = alerts(spark, sf).select("accession", "materiality", F.lit(0).cast("long").alias("enriched"))
    new = lines(spark, sf).where("flag = 'A'").groupBy("accession").agg(F.count("*").alias("enriched"))
    return changes.upsert(old, new, ["accession"])


DENSE = {"rewh": 3.0, "orre": 2.5, "thatin": 2.0, "from": 1.5}


@query("SELECT doc_id, round(least((" + " + ".join(f"{w} * ((length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)})" for k, w in DENSE.items()) + ") / 10.0, 1.0), 4) AS density, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in DENSE) + ") AS found FROM documents WHERE text IS NOT NULL", with_roles=False)
def keyword_densities(spark, sf):
    """Weighted keyword density of a text and the keywords found."""
    own = read(spark, sf, "documents").where("text is not null")
    return own.select("doc_id", F.round(T.keyword_density(F.col("text"), DENSE), 4).alias("density"), F.array_join(T.keywords_found(F.col("text"), list(DENSE)), ",").alias("found"))


@query(f"""WITH {VERSIONS}, x AS (SELECT doc_id, {NUM.format(c='new_text')} AS n, {NUM.format(c='old_text')} AS o FROM pairs), d AS (SELECT doc_id, list_sort(list_filter(o, lambda v: NOT list_contains(n, v)))[1:10] AS gone, list_sort(list_filter(n, lambda v: NOT list_contains(o, v)))[1:10] AS come FROM x)
SELECT doc_id, array_to_string(list_transform(range(1, least(len(gone), len(come)) + 1), lambda i: gone[i] || '>' || come[i]), '|') AS pairs FROM d""", with_roles=False)
def number_pairs(spark, sf):
    """Figures that went beside figures that came, in order, ten pairs at most (the report's feature)."""
    n, o = T.numbers(F.col("new_text")), T.numbers(F.col("old_text"))
    gone, come = F.slice(F.sort_array(F.array_except(o, n)), 1, 10), F.slice(F.sort_array(F.array_except(n, o)), 1, 10)
    both = F.filter(F.zip_with(gone, come, lambda a, b: F.concat(a, F.lit(">"), b)), lambda x: x.isNotNull())
    return versions(spark, sf).select("doc_id", F.array_join(both, "|").alias("pairs"))


META = {"og_title": "property=\"og:title\" content=\"([^\"]*)\"", "author": "name=\"author\" content=\"([^\"]*)\"", "published": "property=\"article:published_time\" content=\"([^\"]*)\"", "description": "name=\"description\" content=\"([^\"]*)\""}


@query("WITH m AS (SELECT page_id, regexp_extract(h, '<title>([^<]*)</title>', 1) AS title, " + ", ".join(f"regexp_extract(h, '{p}', 1) AS {k}" for k, p in META.items()) + """ FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '</title>', '</title><meta property="og:title" content="T' || page_id || '"><meta name="author" content="A B"><meta property="article:published_time" content="2025-01-02">') ELSE html END AS h FROM pages))
SELECT page_id, CASE WHEN og_title <> '' THEN og_title ELSE title END AS title, author, published, description FROM m""", with_roles=False)
def page_meta(spark, sf):
    """Title, author, date and description of a page; a title for sharing overrides the plain one."""
    extra = F.concat(F.lit('</title><meta property="og:title" content="T'), F.col("page_id"), F.lit('"><meta name="author" content="A B"><meta property="article:published_time" content="2025-01-02">'))
    own = read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("</title>"), extra)).otherwise(F.col("html")).alias("h"))
    got = {k: F.regexp_extract("h", p, 1) for k, p in META.items()}
    title = F.when(got["og_title"] != "", got["og_title"]).otherwise(F.regexp_extract("h", "<title>([^<]*)</title>", 1))
    return own.select("page_id", title.alias("title"), got["author"].alias("author"), got["published"].alias("published"), got["description"].alias("description"))
