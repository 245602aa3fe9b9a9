"""Text queries: versions of a text and their changes, lexicon measures, headlines, articles.

A document's prior version is the document of the next smaller id with the same language and first line.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import align, matching, overlap
from ..sources.tables import read
from .base import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

# Word lists bound to the invented prose of the tables.
POSITIVE, NEGATIVE, NEGATORS = ["for", "with"], ["was", "are"], ["that"]
WEIGHTS = {"rewh": 3.0, "orre": 2.5, "thatin": 2.0, "from": 1.5, "this": 0.5}
RISKS = {"bankruptcy": ("rewh", 0.98), "fraud": ("orre", 0.95), "litigation": ("thatin", 0.80), "cybersecurity": ("ndedre", 0.78), "impairment": ("shtion", 0.72)}
BUCKETS = {"REGULATORY": ("with", -1, 0.72), "EARNINGS": ("for", 1, 0.61), "ANALYST": ("that", 1, 0.58), "MACRO": ("this", 0, 0.30), "PRODUCT": ("from", 1, 0.52), "LEADERSHIP": ("was", -1, 0.55)}

VERSIONS = "v AS (SELECT doc_id, text AS new_text, lag(text) OVER (PARTITION BY lang, string_split(text, chr(10))[1] ORDER BY doc_id) AS old_text FROM documents), pairs AS (SELECT * FROM v WHERE old_text IS NOT NULL)"
PARAS = """paras AS (SELECT doc_id, side, k, p, list_distinct(regexp_extract_all(regexp_replace(lower(p), '[0-9]+', '#', 'g'), '[a-z#]+')) AS t FROM (
  SELECT doc_id, side, generate_subscripts(ps, 1) AS k, trim(regexp_replace(unnest(ps), '\\s+', ' ', 'g')) AS p FROM (SELECT doc_id, 'n' AS side, string_split(new_text, chr(10)) AS ps FROM pairs UNION ALL SELECT doc_id, 'o', string_split(old_text, chr(10)) FROM pairs))
  WHERE len(list_filter(string_split(p, ' '), lambda w: w <> '')) >= 15)"""


def versions(spark, sf):
    """(doc_id, new_text, old_text) of documents that have a prior version.

    Ids alone go through windows: within ranges of a thousand ids first, then over the last id of each range, so that a
    common first line is not ordered in one task. The texts join the pairs of ids afterwards."""
    docs = read(spark, sf, "documents").where("text is not null")
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("l"), F.xxhash64(F.element_at(F.split("text", "\n"), 1)).alias("h"), F.expr("doc_id div 1000").alias("lot"))
    before = own.groupBy("l", "h", "lot").agg(F.max("doc_id").alias("top")).select("l", "h", "lot", F.lag("top").over(W.partitionBy("l", "h").orderBy("lot")).alias("earlier"))
    own = own.withColumn("near", F.lag("doc_id").over(W.partitionBy("l", "h", "lot").orderBy("doc_id"))).join(before, ["l", "h", "lot"])
    pairs = own.select("doc_id", F.coalesce("near", "earlier").alias("prior")).where("prior is not null")
    return docs.select("doc_id", F.col("text").alias("new_text")).join(pairs, "doc_id").join(docs.select(F.col("doc_id").alias("prior"), F.col("text").alias("old_text")), "prior").select("doc_id", "new_text", "old_text")


@query(f"""WITH {VERSIONS}, {PARAS},
x AS (SELECT n.doc_id, n.k AS nk, o.k AS ok, CASE WHEN len(n.t) + len(o.t) = 0 THEN 1.0 ELSE len(list_intersect(n.t, o.t)) / (len(n.t) + len(o.t) - len(list_intersect(n.t, o.t)))::DOUBLE END AS s FROM paras n JOIN paras o ON n.doc_id = o.doc_id AND n.side = 'n' AND o.side = 'o'),
c AS (SELECT p.doc_id, p.side, p.k, coalesce(max(x.s), 0) AS s FROM paras p LEFT JOIN x ON x.doc_id = p.doc_id AND CASE WHEN p.side = 'n' THEN x.nk ELSE x.ok END = p.k GROUP BY 1, 2, 3),
a AS (SELECT doc_id, count(*) FILTER (WHERE side = 'n') AS paragraphs, count(*) FILTER (WHERE side = 'n' AND s < 0.5) AS added, count(*) FILTER (WHERE side = 'n' AND s >= 0.5 AND s < 0.8) AS modified, count(*) FILTER (WHERE side = 'o' AND s < 0.5) AS removed FROM c GROUP BY doc_id)
SELECT p.doc_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(removed, 0) AS removed,
  CASE WHEN coalesce(paragraphs, 0) + coalesce(removed, 0) > 0 THEN round((added + modified + removed) / (paragraphs + removed)::DOUBLE, 3) ELSE 0.0 END AS change_ratio FROM pairs p LEFT JOIN a ON a.doc_id = p.doc_id""", with_roles=False)
def jaccard_section_change(spark, sf):
    """Paragraphs unchanged, modified, added and removed against the prior version."""
    return align.section_change(versions(spark, sf)).select("doc_id", "paragraphs", "added", "modified", "removed", "change_ratio")


def _both_paragraphs(spark, sf):
    """(key, new, old): lower-case paragraphs of each document and of its prior version."""
    low = lambda name: T.paragraphs(F.lower(name)).alias(name[:3])
    return versions(spark, sf).select(F.col("doc_id").alias("key"), low("new_text"), low("old_text"))


@query(None)
def greedy_alignment(spark, sf):
    """Greedy TF-IDF alignment of each document's paragraphs with its prior version's."""
    out = matching.greedy_versions(_both_paragraphs(spark, sf))
    return out.select(F.col("key").alias("doc_id"), "change", "new_at", "old_at", F.round("score", 6).alias("score"))


@query(None)
def opcode_alignment(spark, sf):
    """Paragraph alignment by edit opcodes."""
    run = align.aligner(align.opcode_pairs)
    out = versions(spark, sf).where(F.sha2("new_text", 256) != F.sha2("old_text", 256)).select("doc_id", F.explode(run(T.paragraphs(F.col("new_text")), T.paragraphs(F.col("old_text")))).alias("m"))
    return out.select("doc_id", "m.change", "m.new_at", "m.old_at", F.round("m.score", 6).alias("score"))


@query(f"WITH {VERSIONS} SELECT doc_id, CASE WHEN substr(sha256(new_text), 1, 16) = substr(sha256(old_text), 1, 16) THEN 'unchanged' ELSE 'modified' END AS status, substr(sha256(new_text), 1, 16) AS fingerprint FROM pairs", with_roles=False)
def fingerprint_status(spark, sf):
    """Status by fingerprint, before any dearer comparison."""
    same = T.fingerprint(F.col("new_text")) == T.fingerprint(F.col("old_text"))
    return versions(spark, sf).select("doc_id", F.when(same, "unchanged").otherwise("modified").alias("status"), T.fingerprint(F.col("new_text")).alias("fingerprint"))


NUM = "list_distinct(list_transform(regexp_extract_all(lower({c}), '\\$?[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda n: replace(n, ',', '')))"


@query(f"WITH {VERSIONS}, x AS (SELECT doc_id, {NUM.format(c='new_text')} AS n, {NUM.format(c='old_text')} AS o FROM pairs) SELECT doc_id, array_to_string(list_sort(list_filter(n, lambda v: NOT list_contains(o, v))), '|') AS added, array_to_string(list_sort(list_filter(o, lambda v: NOT list_contains(n, v))), '|') AS removed FROM x", with_roles=False)
def number_changes(spark, sf):
    """Figures that came and went, sorted."""
    n, o = T.numbers(F.col("new_text")), T.numbers(F.col("old_text"))
    return versions(spark, sf).select("doc_id", F.array_join(F.sort_array(F.array_except(n, o)), "|").alias("added"), F.array_join(F.sort_array(F.array_except(o, n)), "|").alias("removed"))


@query(f"""WITH {VERSIONS}, x AS (SELECT doc_id, list_filter(regexp_split_to_array(old_text, '\\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(new_text, '\\s+'), lambda w: w <> '') AS b FROM pairs),
d AS (SELECT doc_id, a, b, coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, least(len(a), len(b)) + 1)) AS i) WHERE a[i] <> b[i]), least(len(a), len(b))) AS pos FROM x), s AS (SELECT *, CASE WHEN pos > 12 THEN pos - 6 ELSE 0 END AS st FROM d)
SELECT doc_id, CASE WHEN st > 0 THEN '...' ELSE '' END || array_to_string(a[st + 1:], ' ') AS before, CASE WHEN st > 0 THEN '...' ELSE '' END || array_to_string(b[st + 1:], ' ') AS after FROM s""", with_roles=False)
def diff_window(spark, sf):
    """Both versions from six words before their first difference."""
    before, after = T.first_difference(T.words(F.col("old_text")), T.words(F.col("new_text")))
    return versions(spark, sf).select("doc_id", before.alias("before"), after.alias("after"))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) >= 15)) AS n_paragraphs, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words FROM documents""", with_roles=False)
def paragraph_split_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 20)) AS n_sentences FROM documents", with_roles=False)
def sentence_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


DENSITY = "least((" + " + ".join(f"{w} * CAST((length(lower({{c}})) - length(replace(lower({{c}}), '{k}', ''))) / {len(k)} AS INTEGER)" for k, w in WEIGHTS.items()) + ") / 10.0, 1.0)"
TOK = "regexp_extract_all(lower({c}), '[a-z]+(?:''[a-z]+)?')"


def _sent_sql(c: str) -> str:
    lists = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in (("p", POSITIVE), ("n", NEGATIVE), ("g", NEGATORS))}
    tok = TOK.format(c=c)
    return f"(SELECT tanh(coalesce(sum(CASE WHEN list_has_any(t[greatest(i - 3, 1):i - 1], {lists['g']}) AND i > 1 THEN -1.0 ELSE 1.0 END * CASE WHEN list_contains({lists['p']}, t[i]) THEN 1.0 WHEN list_contains({lists['n']}, t[i]) THEN -1.0 ELSE 0.0 END), 0) / greatest(1.0, max(len(t)) / 50.0)) FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {tok} AS t)))"


@query(f"""WITH {VERSIONS}, x AS (SELECT doc_id, {DENSITY.format(c='new_text')} AS kw, coalesce({_sent_sql('new_text')}, 0) - coalesce({_sent_sql('old_text')}, 0) AS ds,
  list_distinct({TOK.format(c='new_text')}) AS n, list_distinct({TOK.format(c='old_text')}) AS o FROM pairs),
y AS (SELECT doc_id, kw, ds, CASE WHEN len(n) + len(o) = 0 THEN 0.0 ELSE 1 - len(list_intersect(n, o)) / (len(n) + len(o) - len(list_intersect(n, o)))::DOUBLE END AS ed FROM x)
SELECT doc_id, round(0.5 * kw + 0.25 * least(abs(ds) / 2, 1.0) + 0.25 * ed, 4) AS materiality FROM y""", with_roles=False)
def nlp_materiality(spark, sf):
    """Keyword density, sentiment shift and word-set edits of a version, blended."""
    pattern = "[a-z]+(?:'[a-z]+)?"
    n, o = T.tokens(F.col("new_text"), pattern), T.tokens(F.col("old_text"), pattern)
    kw = T.keyword_density(F.col("new_text"), WEIGHTS)
    own = versions(spark, sf).withColumn("n", n).withColumn("o", o).withColumn("kw", kw)
    shift = T.sentiment(F.col("n"), POSITIVE, NEGATIVE, NEGATORS) - T.sentiment(F.col("o"), POSITIVE, NEGATIVE, NEGATORS)
    edits = T.edit_ratio(F.array_distinct("n"), F.array_distinct("o"))
    return own.select("doc_id", F.round(0.5 * F.col("kw") + 0.25 * F.least(F.abs(shift) / 2, F.lit(1.0)) + 0.25 * edits, 4).alias("materiality"))


RISK_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, len(regexp_extract_all(lower(text), '{w}')) AS hits, {b} AS base FROM documents" for k, (w, b) in RISKS.items())


@query(f"""WITH s AS (SELECT doc_id, category, hits, round(least(base * ln(1 + hits), 1.0), 6) AS signal FROM ({RISK_SQL}) WHERE hits > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY signal DESC, category) AS k FROM s)
SELECT doc_id, count(*) AS n_categories, CAST(sum(hits) AS BIGINT) AS n_hits, round(avg(signal) FILTER (WHERE k <= 3), 4) AS composite FROM r GROUP BY doc_id""", with_roles=False)
def risk_signals(spark, sf):
    """Red-flag categories of a text; the composite is the mean of its three strongest."""
    low = F.lower("text")
    found = F.array(*[F.struct(F.round(scores.risk_signal(F.lit(b), F.regexp_count(low, F.lit(w))), 6).alias("signal"), F.lit(k).alias("category"), F.regexp_count(low, F.lit(w)).alias("hits")) for k, (w, b) in RISKS.items()])
    own = read(spark, sf, "documents").select("doc_id", F.filter(found, lambda x: x["hits"] > 0).alias("s")).where("size(s) > 0")
    top = F.slice(F.sort_array(F.transform("s", lambda x: x["signal"]), asc=False), 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top)
    return own.select("doc_id", F.size("s").cast("long").alias("n_categories"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["hits"]).alias("n_hits"), F.round(mean, 4).alias("composite"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{2,}'), lambda w: NOT list_contains(['the', 'and', 'of', 'to'], w)) AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, least(5, len(w) - 1) + 1), lambda i: w[i] || ' ' || w[i + 1]), '|') AS bigrams, len(w) AS n FROM t""", with_roles=False)
def topic_keywords(spark, sf):
    """Content words and the first five bigrams."""
    stop = F.array(*[F.lit(x) for x in ("the", "and", "of", "to")])
    own = read(spark, sf, "documents").select("doc_id", F.filter(T.tokens(F.col("text"), "[a-z]{2,}"), lambda w: ~F.array_contains(stop, w)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.least(F.lit(5), F.size("w") - 1), F.lit(0))), F.slice("w", 2, F.greatest(F.least(F.lit(5), F.size("w") - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return own.select("doc_id", F.array_join(pairs, "|").alias("bigrams"), F.size("w").cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(text, '(?:NYSE|NASDAQ): ?([A-Z]{1,5})', 1), regexp_extract_all(text, '\\(([A-Z]{1,5})\\)', 1), list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda x: regexp_full_match(x, '[A-Z]{2,5}')))) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(['THE', 'AND', 'CEO', 'SEC'], x)))[1:20], ',') AS tickers FROM t""", with_roles=False)
def ticker_mentions(spark, sf):
    """Symbols named in a text, common words left out, the first twenty by name."""
    found = F.concat(F.regexp_extract_all("text", F.lit("(?:NYSE|NASDAQ): ?([A-Z]{1,5})"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\(([A-Z]{1,5})\)"), F.lit(1)), F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x.rlike("^[A-Z]{2,5}$")))
    common = F.array(*[F.lit(x) for x in ("THE", "AND", "CEO", "SEC")])
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.sort_array(F.array_except(found, common)), 1, 20), ",").alias("tickers"))


HEADS = "heads AS (SELECT conv_id, turn, lower(string_split(text, chr(10))[1]) AS h FROM conversations)"
BUCKET_SQL = ", ".join(f"CASE WHEN regexp_matches(h, '\\b{w}\\b') THEN {{'n': '{k}', 'w': {d * c}::DOUBLE, 'o': {i}}} END" for i, (k, (w, d, c)) in enumerate(BUCKETS.items()))


def _heads(spark, sf):
    own = read(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.element_at(F.split("text", "\n"), 1)).alias("h"))
    found = F.array_compact(F.array(*[F.when(F.col("h").rlike(rf"\b{w}\b"), F.struct(F.lit(k).alias("n"), F.lit(float(d * c)).alias("w"), F.lit(i).alias("o"))) for i, (k, (w, d, c)) in enumerate(BUCKETS.items())]))
    return own.withColumn("b", found)


@query(f"""WITH {HEADS}, b AS (SELECT conv_id, turn, list_filter([{BUCKET_SQL}], lambda x: x IS NOT NULL) AS b FROM heads), u AS (SELECT conv_id, unnest(b) AS x FROM b), t AS (SELECT conv_id, x.n AS bucket, x.o AS o, count(*) AS c FROM u GROUP BY 1, 2, 3),
top AS (SELECT conv_id, bucket, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, o) AS k FROM t), s AS (SELECT conv_id, count(*) AS n, round(sum(coalesce(list_sum(list_transform(b, lambda x: x.w)), 0)), 6) AS raw FROM b GROUP BY conv_id)
SELECT s.conv_id, n, raw, round(1 / (1 + exp(-3 * raw / (n * 0.72))), 6) AS quality, coalesce(top.bucket, 'NONE') AS top_bucket FROM s LEFT JOIN top ON top.conv_id = s.conv_id AND k = 1""", with_roles=False)
def headline_buckets(spark, sf):
    """Headlines put into buckets; signed weights, quality and the most frequent bucket of each feed."""
    own = _heads(spark, sf)
    raw = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["w"])
    total = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum(raw), 6).alias("raw"))
    count = own.select("conv_id", F.explode("b").alias("x")).groupBy("conv_id", "x.n", "x.o").agg(F.count("*").alias("c"))
    top = count.groupBy("conv_id").agg(F.max_by("n", F.struct(F.col("c"), -F.col("o"))).alias("top"))
    return total.join(top, "conv_id", "left").select("conv_id", "n", "raw", F.round(scores.headline_quality(F.col("raw"), F.col("n")), 6).alias("quality"), F.coalesce("top", F.lit("NONE")).alias("top_bucket"))


@query(f"""WITH {HEADS}, b AS (SELECT conv_id, turn, list_filter([{BUCKET_SQL}], lambda x: x IS NOT NULL) AS b FROM heads),
q AS (SELECT conv_id, CASE WHEN len(b) = 0 THEN 0.5 ELSE 1 / (1 + exp(3 * list_sum(list_transform(b, lambda x: x.w)) / (len(b) * 0.72))) END AS q FROM b),
f AS (SELECT conv_id, count(*) AS n, avg(q) AS mean FROM q GROUP BY conv_id)
SELECT conv_id, n, round(mean, 6) AS mean, round(0.35 * least(greatest(ln(1 + n) / ln(21.0), 0.05), 1.0) + 0.65 * mean, 6) AS composite, round(0.35 * least(greatest(ln(1 + n) / ln(21.0), 0.05), 1.0) + 0.65 * mean, 6) > 0.45 AS important FROM f""", with_roles=False)
def feed_importance(spark, sf):
    """Article quality, feed composite and whether the feed matters."""
    raw = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["w"])
    q = F.when(F.size("b") == 0, 0.5).otherwise(scores.article_quality(raw, F.size("b"), F.lit(0.72)))
    own = _heads(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(q).alias("mean"))
    composite = F.round(0.35 * scores.clamp(F.log1p("n") / F.log1p(F.lit(20.0)), 0.05, 1.0) + 0.65 * F.col("mean"), 6)
    return own.select("conv_id", "n", F.round("mean", 6).alias("mean"), composite.alias("composite"), (composite > 0.45).alias("important"))


@query("""WITH a AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.4 END AS auth, CASE WHEN value >= 90 THEN 1.5 ELSE 1.0 END AS boost, greatest(0, least(72, (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 3600.0)) AS age, value / 100 AS ping FROM events),
s AS (SELECT event_id, round(0.4 * least(auth * pow(2.0, -age / 6.0) * boost, 1.0) + 0.6 * ping, 6) AS score FROM a) SELECT event_id, score FROM s WHERE score >= 0.10 ORDER BY score DESC, event_id LIMIT 100""", with_roles=False)
def relevance_rank(spark, sf):
    """Authority, recency and boost of an article blended with its ping score; the top hundred."""
    own = read(spark, sf, "events")
    own = own.withColumn("now", own.agg(F.max("ts")).scalar())
    e = F.col("event_type")
    auth = F.when(e == "purchase", 1.0).when(e == "signup", 0.9).when(e == "click", 0.6).otherwise(0.4)
    boost = F.when(F.col("value") >= 90, 1.5).otherwise(1.0)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    base = F.least(auth * scores.recency((seconds("now") - seconds("ts")) / 3600.0) * boost, F.lit(1.0))
    return own.select("event_id", F.round(0.4 * base + 0.6 * F.col("value") / 100, 6).alias("score")).where("score >= 0.10").orderBy(F.desc("score"), "event_id").limit(100)


@query("""WITH pings AS (SELECT * FROM (VALUES (1, ['with', 'for', 'that']), (2, ['rewh', 'orre']), (3, ['this', 'from', 'was', 'are'])) AS t(ping_id, kw)),
m AS (SELECT d.doc_id, p.ping_id, round(0.6 * len(list_filter(p.kw, lambda k: contains(lower(d.text), k))) / len(p.kw) + 0.4 * CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END, 6) AS relevance FROM documents d CROSS JOIN pings p)
SELECT doc_id, ping_id, relevance FROM m WHERE relevance >= 0.75""", with_roles=False)
def ping_match(spark, sf):
    """Texts against standing topics: keyword share and symbol hit; the few topics unfold inside each row."""
    pings = {1: ["with", "for", "that"], 2: ["rewh", "orre"], 3: ["this", "from", "was", "are"]}
    hit = F.when(F.col("lang") == "en", 1).otherwise(0)
    rows = F.array(*[F.struct(F.lit(k).alias("ping_id"), F.round(0.6 * F.size(T.keywords_found(F.col("text"), kw)) / len(kw) + 0.4 * hit, 6).alias("relevance")) for k, kw in pings.items()])
    return read(spark, sf, "documents").select("doc_id", F.inline(rows)).where("relevance >= 0.75")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, 'charset=\"([^\"]+)\"', 1) AS charset FROM pages", with_roles=False)
def page_meta_extract(spark, sf):
    return read(spark, sf, "pages").select("page_id", *[F.regexp_extract("html", p, 1).alias(n) for n, p in (("title", "<title>([^<]*)</title>"), ("lang", '<html lang="([a-z]+)"'), ("charset", 'charset="([^"]+)"'))])


@query("SELECT doc_id, sum(CASE WHEN w IN ('for', 'from') THEN 1 ELSE 0 END)::BIGINT AS soft, sum(CASE WHEN w IN ('was', 'this') THEN 1 ELSE 0 END)::BIGINT AS hard FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\b(?:for|from|was|this)\\b')) AS w FROM documents) GROUP BY doc_id", with_roles=False)
def hedge_counts(spark, sf):
    """Soft and firm words of a text."""
    low = F.lower("text")
    return read(spark, sf, "documents").select("doc_id", F.regexp_count(low, F.lit(r"\b(?:for|from)\b")).cast("long").alias("soft"), F.regexp_count(low, F.lit(r"\b(?:was|this)\b")).cast("long").alias("hard")).where("soft + hard > 0")


PLAIN = PARAS.replace("list_distinct(regexp_extract_all(regexp_replace(lower(p), '[0-9]+', '#', 'g'), '[a-z#]+')) AS t", "regexp_extract_all(lower(p), '[a-z]+') AS t")


@query(f"""WITH {VERSIONS}, {PLAIN}, q AS (SELECT doc_id, side, t, row_number() OVER (PARTITION BY doc_id, side ORDER BY k) - 1 AS pos FROM paras), sz AS (SELECT doc_id, count(*) AS n FROM q GROUP BY 1),
tm AS (SELECT doc_id, side, pos, len(t) AS l, unnest(t) AS term FROM q), tc AS (SELECT doc_id, side, pos, l, term, count(*) AS c FROM tm GROUP BY ALL), d AS (SELECT doc_id, term, count(*) AS df FROM tc GROUP BY 1, 2),
w AS (SELECT tc.doc_id, side, pos, tc.term, c / l::DOUBLE * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tc JOIN d ON d.doc_id = tc.doc_id AND d.term = tc.term JOIN sz ON sz.doc_id = tc.doc_id), nm AS (SELECT doc_id, side, pos, sqrt(sum(w * w)) AS nm FROM w GROUP BY 1, 2, 3),
p AS (SELECT a.doc_id, a.pos AS new_at, b.pos AS old_at, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND a.side = 'n' AND b.side = 'o' GROUP BY 1, 2, 3)
SELECT p.doc_id, p.new_at, p.old_at, round(dot / (x.nm * y.nm), 4) AS cosine FROM p JOIN nm x ON x.doc_id = p.doc_id AND x.side = 'n' AND x.pos = p.new_at JOIN nm y ON y.doc_id = p.doc_id AND y.side = 'o' AND y.pos = p.old_at WHERE dot / (x.nm * y.nm) >= 0.5""", with_roles=False)
def tfidf_cosine_pairs(spark, sf):
    """Paragraph pairs of two versions with a TF-IDF cosine of at least one half."""
    out = overlap.cosine_pairs(_both_paragraphs(spark, sf), 0.5)
    return out.select(F.col("key").alias("doc_id"), "new_at", "old_at", F.round("cosine", 4).alias("cosine"))


def _conversation_versions(spark, sf):
    """Each turn beside the turn before it of the same role."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("new"), F.lag("text").over(w).alias("old")).where("old is not null")


@query(None)
def char_similarity(spark, sf):
    """Character similarity of successive turns; equal fingerprints are not compared."""
    own = _conversation_versions(spark, sf)
    same = T.fingerprint(F.col("old")) == T.fingerprint(F.col("new"))
    return own.select("conv_id", "turn", F.when(same, 1.0).otherwise(F.round(align.text_ratio()("old", "new"), 6)).alias("similarity"))


@query(None)
def word_diff_spans(spark, sf):
    """Word diff of successive turns as tagged spans."""
    return _conversation_versions(spark, sf).select("conv_id", "turn", F.explode(align.word_spans()("old", "new")).alias("s")).select("conv_id", "turn", "s.tag", "s.text")


@query(None)
def sentence_novelty(spark, sf):
    """Sentences of a turn unlike every one of the turn before."""
    run = align.novelty()
    own = _conversation_versions(spark, sf).select("conv_id", "turn", T.sentences(F.col("old")).alias("old"), T.sentences(F.col("new")).alias("new"))
    return own.select("conv_id", "turn", F.explode(run("old", "new")).alias("sentence"))
