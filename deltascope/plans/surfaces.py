"""Statuses of sections, plain-text readers, routing, listings and imports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, segment
from ..sources import feeds
from ..sources.scratch import scratch
from ..sources.tables import read
from .base import registrar
from .roles import alerts, lines
from .segments import _ITEMS, filing_texts

QUERIES: dict = {}
query = registrar(QUERIES)


@query(_ITEMS + """, s AS (SELECT doc, form, key, substr(sha256(text), 1, 16) AS mark FROM r WHERE length(text) > 100 QUALIFY row_number() OVER (PARTITION BY doc, key ORDER BY length(text) DESC, section) = 1),
d AS (SELECT doc_id AS doc, lag(doc_id) OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS prior FROM documents), n AS (SELECT d.doc, s.key, s.mark FROM d JOIN s ON s.doc = d.doc WHERE prior IS NOT NULL), o AS (SELECT d.doc, s.key, s.mark FROM d JOIN s ON s.doc = d.prior)
SELECT coalesce(n.doc, o.doc) AS doc, coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN n.mark = o.mark THEN 'unchanged' ELSE 'modified' END AS status FROM n FULL JOIN o ON n.doc = o.doc AND n.key = o.key""", with_roles=False)
def section_statuses(spark, sf):
    """Sections of each filing against those of the one before it of like form, told apart by fingerprints: the texts are
    hashed before anything is joined."""
    own = segment.item_sections(filing_texts(spark, sf), keep="longest", least=100).where("key <> '0'").select("doc", "key", T.fingerprint(F.col("text")).alias("mark"))
    ids = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 3).alias("kind"), F.expr("doc_id div 1000").alias("lot"))
    before = ids.groupBy("kind", "lot").agg(F.max("doc").alias("top")).select("kind", "lot", F.lag("top").over(W.partitionBy("kind").orderBy("lot")).alias("earlier"))
    ids = ids.withColumn("near", F.lag("doc").over(W.partitionBy("kind", "lot").orderBy("doc"))).join(before, ["kind", "lot"]).select("doc", F.coalesce("near", "earlier").alias("prior")).where("prior is not null")
    new, old = own.join(ids.select("doc"), "doc"), ids.join(own.withColumnRenamed("doc", "prior"), "prior").select("doc", "key", F.col("mark").alias("was"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("mark").isNull(), "removed").when(F.col("mark") == F.col("was"), "unchanged").otherwise("modified")
    return new.join(old, ["doc", "key"], "full_outer").select("doc", "key", status.alias("status"))


@query(_ITEMS + "SELECT doc, label, left(text, 10000) AS text FROM r WHERE text <> ''", with_roles=False)
def labelled_sections(spark, sf):
    """Raw sections under ``Item n - title``, cut to 10,000 characters (the feed's feature)."""
    return segment.item_sections(filing_texts(spark, sf), clip=10_000).where("text <> ''").select("doc", "label", "text")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(8217), ''''), chr(8212), '-'), chr(10)), lambda x: rtrim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^ ?(page )?[0-9]{1,3}$', 'i') AND NOT regexp_matches(x, '^ ?[.\-_ ]{3,}')) AS l FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM l""", with_roles=False)
def plain_text_filings(spark, sf):
    """Filings that come as plain text: quotes and dashes made plain, page numbers and rules dropped, blank lines made one."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("’"), F.lit("'")), F.lit("—"), F.lit("-"))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), " +$", "")), lambda x: ~x.rlike(r"(?i)^ ?(page )?[0-9]{1,3}$") & ~x.rlike(r"^ ?[.\-_ ]{3,}"))
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "").alias("text"))


@query(r"""WITH n AS (SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style|head)[^>]*>.*?</(script|style|head)>', '', 'gs'), '<[^>]*>'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS n FROM pages)
SELECT page_id, len(n) AS nodes, array_to_string(n, chr(10)) AS text FROM n""", with_roles=False)
def page_text_nodes(spark, sf):
    """Pages as one line a text node, scripts, styles and heads left out, references as they stand."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<!--.*?-->", ""), "(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>", "")
    nodes = F.filter(F.transform(F.split(bare, "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return read(spark, sf, "pages").select("page_id", nodes.alias("n")).select("page_id", F.size("n").cast("long").alias("nodes"), F.array_join("n", "\n").alias("text"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(left(t, 77), ' [^ ]*$', '') || '...' END AS short FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)""", with_roles=False)
def report_lines(spark, sf):
    """Texts shortened to a line of a report, at a word's end."""
    return read(spark, sf, "documents").select("doc_id", T.clip(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 80).alias("short"))


@query("SELECT doc_id, len(list_filter(p, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 15)) AS fifteen, len(list_filter(p, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 20)) AS twenty FROM (SELECT doc_id, string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n{2,}') AS p FROM documents)", with_roles=False)
def blank_line_paragraphs(spark, sf):
    """Paragraphs between blank lines, of fifteen words and of twenty."""
    p = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), r"\n{2,}")
    n = lambda k: F.size(F.filter(p, lambda x: F.size(T.words(x)) >= k)).cast("long")
    return read(spark, sf, "documents").select("doc_id", n(15).alias("fifteen"), n(20).alias("twenty"))


#: Branches of a question in order, bound to the invented prose: the first whose pattern is found answers.
ROUTES = (("count", r"\bwith\b"), ("latest", r"\bthis\b"), ("top", r"\bfrom\b"), ("form", r"\bwas\b"), ("company", r"\bthat\b"))


@query("SELECT route, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in ROUTES) + " ELSE 'search' END AS route FROM conversations) GROUP BY route", with_roles=False)
def question_routes(spark, sf):
    """Questions by the branch that answers them."""
    route = F.lit("search")
    for k, p in reversed(ROUTES):
        route = F.when(F.lower("text").rlike(p), k).otherwise(route)
    return read(spark, sf, "conversations").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("SELECT accession, ranking, form FROM alerts WHERE ranking IN (1, 3, 5) AND upper(form) = '10-K'")
def alerts_of_ranks(spark, sf):
    """Alerts of several ranks at once and one form, whatever its case."""
    return alerts(spark, sf).where(F.col("ranking").isin(1, 3, 5) & (F.upper("form") == "10-K")).select("accession", "ranking", "form")


@query("WITH s AS (SELECT accession, flag, sum(disc) * 1.0::DOUBLE / count(*) AS score FROM lines GROUP BY 1, 2) SELECT accession, round(avg(score), 4) AS materiality FROM s GROUP BY accession")
def mean_item_scores(spark, sf):
    """Filing materiality as the plain mean of its items' scores."""
    own = lines(spark, sf).groupBy("accession", "flag").agg((F.sum("disc") / F.count("*")).alias("score"))
    return own.groupBy("accession").agg(F.round(F.avg("score"), 4).alias("materiality"))


@query("WITH f AS (SELECT user_id, count(*) AS n, avg(CAST(round(value * 100) AS BIGINT)) / 20000 AS quality, mode() WITHIN GROUP (ORDER BY event_type) AS dummy FROM events GROUP BY user_id), t AS (SELECT user_id, max_by(event_type, (c, event_type)) AS top FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1) SELECT f.user_id, quality > 0.55 AS loud, quality > 0.65 AS louder, quality > 0.25 OR (top = 'click' AND n >= 3) AS important FROM f JOIN t ON t.user_id = f.user_id", with_roles=False)
def importance_rules(spark, sf):
    """Whether a feed matters: by quality at each threshold, or by its top bucket with three items or more."""
    own = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"))
    own = own.groupBy("user_id").agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c") / 20000).alias("quality"), F.max_by("event_type", F.struct("c", "event_type")).alias("top"))
    q = F.col("quality")
    return own.select("user_id", (q > 0.55).alias("loud"), (q > 0.65).alias("louder"), ((q > 0.25) | ((F.col("top") == "click") & (F.col("n") >= 3))).alias("important"))


@query("SELECT event_id, event_type FROM events WHERE value < 50", with_roles=False)
def unread_notifications(spark, sf):
    """Landed notifications that nobody has read; the lines of views once more were cut off while they were written, and are skipped."""
    path = scratch(spark, "inbox")
    line = F.to_json(F.struct("event_id", "event_type", (F.col("value") >= 50).alias("read")))
    own = read(spark, sf, "events")
    own.select(line.alias("value")).union(own.where("event_type = 'view'").select(F.substring(line, 1, 14))).write.text(path)
    return feeds.read_json(spark, path, "event_id bigint, event_type string, read boolean", "DROPMALFORMED").where("not read").select("event_id", "event_type")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)", with_roles=False)
def file_import(spark, sf):
    """Rows of a landed CSV file that are not there yet."""
    path = scratch(spark, "import")
    read(spark, sf, "part").select("p_partkey", "p_name").write.csv(path, header=True)
    new = feeds.read_csv(spark, path, "k bigint, name string")
    return changes.insert_or_ignore(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), new, ["k"])
