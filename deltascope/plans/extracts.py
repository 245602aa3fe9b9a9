"""What filings hold: tables as rows, text around tables, phrases of many categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, index, phrases, segment, stored, tables
from ..sources.scratch import scratch
from ..sources.tables import read
from .base import registrar
from .roles import lines

QUERIES: dict = {}
query = registrar(QUERIES)


def filing_pages(spark, sf):
    """(accession, html): each filing's lines as a table with a heading over two columns, and a table within its last row."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("seq", "cents", "disc"))), lambda x: F.concat(F.lit("<tr><td>"), x["seq"], F.lit("<td>&#36;"), x["cents"], F.lit("</td>\n<td> "), x["disc"], F.lit("&nbsp;</td></tr>")))
    own = lines(spark, sf).groupBy("accession").agg(F.array_join(row, "").alias("rows"), F.count("*").alias("n"))  # one filing's lines
    parts = ["<html><head><style>td{}</style></head><body><p>Filing ", F.col("accession"), "</p><p>12</p><table><tr><th>seq</th><th colspan=\"2\">amount</th></tr><tr></tr>", F.col("rows"),
             "<tr><td colspan=3>notes<table><tr><th>k</th></tr><tr><td>", F.col("n"), "</td></tr></table></td></tr></table><p>Contents ..... 3</p><p>“End”</p></body></html>"]
    return own.select("accession", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"))


@query("""WITH n AS (SELECT accession, seq, cents, disc, CAST(row_number() OVER (PARTITION BY accession ORDER BY seq, cents, disc) - 1 AS INTEGER) AS r, CAST(count(*) OVER (PARTITION BY accession) AS INTEGER) AS n FROM lines), a AS (SELECT DISTINCT accession, n FROM n)
SELECT accession, 0 AS table_no, -1 AS parent, r AS row_no, c AS col_no, CASE c WHEN 0 THEN 'seq' ELSE 'amount' END AS header, CASE c WHEN 0 THEN CAST(seq AS VARCHAR) WHEN 1 THEN '$' || cents ELSE CAST(disc AS VARCHAR) END AS value FROM n, range(3) t(c)
UNION ALL SELECT accession, 0, -1, n, c, CASE c WHEN 0 THEN 'seq' ELSE 'amount' END, 'notes [TABLE]' FROM a, range(3) t(c)
UNION ALL SELECT accession, 1, 0, 0, 0, 'k', CAST(n AS VARCHAR) FROM a""")
def filing_table_cells(spark, sf):
    """Every cell of every table of the filings, with its heading; spans filled, nested tables apart."""
    return tables.table_cells(filing_pages(spark, sf), "accession", "html")


@query("SELECT accession, 'Filing ' || accession || chr(10) || chr(10) || '[TABLE]' || chr(10) || chr(10) || '\"End\"' AS text, CAST(1 AS BIGINT) AS n_tables FROM (SELECT DISTINCT accession FROM lines)")
def filing_text_around_tables(spark, sf):
    """Filings as text with a mark for each outer table, plain quotes, and no page numbers or lines of contents."""

    @F.pandas_udf("struct<text: string, n: long>")
    def around(pages):
        import pandas as pd

        out = [segment.html_with_tables(x) for x in pages]
        return pd.DataFrame({"text": [t for t, _ in out], "n": [len(found) for _, found in out]})

    own = filing_pages(spark, sf).select("accession", around("html").alias("x"))
    return own.select("accession", "x.text", F.col("x.n").alias("n_tables"))


FLAGGED = """d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
p AS (SELECT category, phrase, max(weight) AS weight FROM (SELECT item_id % 14 AS category, array_to_string(w[i:i + 1], ' ') AS phrase, 50 + item_id % 49 AS weight FROM b, range(1, 7) t(i) UNION ALL SELECT item_id % 14, array_to_string(w[i:i + 2], ' '), 50 + item_id % 49 FROM b, range(3, 6) t(i)) WHERE phrase <> '' GROUP BY 1, 2),
u AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d), v AS (SELECT doc_id, i, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, a AS phrase FROM v UNION ALL SELECT doc_id, i, a || ' ' || b FROM v WHERE b IS NOT NULL UNION ALL SELECT doc_id, i, a || ' ' || b || ' ' || c FROM v WHERE c IS NOT NULL),
h AS (SELECT doc_id, category, i, phrase, weight FROM g JOIN p USING (phrase))"""


def flag_phrases(spark, sf):
    """(category, phrase, weight): fourteen categories of phrases of two and three words, from the benchmark table."""
    w = phrases.words_of(F.col("text"))
    own = read(spark, sf, "benchmark").select((F.col("item_id") % 14).alias("category"), (50 + F.col("item_id") % 49).alias("weight"), w.alias("w"))
    cut = lambda low, high, n: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    return own.select("category", "weight", F.explode(F.concat(cut(1, 6, 2), cut(3, 5, 3))).alias("phrase"))


@query(f"""WITH {FLAGGED}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY i, phrase) AS n FROM h),
c AS (SELECT doc_id, category, count(*) AS hits, max(weight) AS weight, list(i ORDER BY n) FILTER (WHERE n <= 3) AS places FROM x GROUP BY 1, 2),
y AS (SELECT c.*, array_to_string(w, ' ') AS prose, list_transform(places, lambda i: len(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 2 ELSE 1 END) AS ats FROM c JOIN d USING (doc_id))
SELECT doc_id, category, hits, weight, array_to_string(list_transform(ats, lambda a: substr(prose, greatest(1, a - 50), a + 200 - greatest(1, a - 50))), '|') AS excerpts FROM y""", with_roles=False)
def red_flag_categories(spark, sf):
    """Hits of fourteen categories of phrases, which a table holds, in every document, with three excerpts each."""
    texts = read(spark, sf, "documents").select("doc_id", "text")
    found = phrases.find_phrases(texts, flag_phrases(spark, sf), "doc_id")
    out = phrases.category_hits(texts, found, "doc_id")
    return out.select("doc_id", "category", "hits", "weight", F.array_join("excerpts", "|").alias("excerpts"))


@query(f"WITH {FLAGGED} SELECT doc_id, least(100.0, sum(weight * least(hits, 5)) / 20.0) AS score, count(*) AS categories FROM (SELECT doc_id, category, max(weight) AS weight, count(*) AS hits FROM h GROUP BY 1, 2) GROUP BY doc_id", with_roles=False)
def red_flag_scores(spark, sf):
    """A risk score of each document from the weights of its categories, five hits of each counting."""
    found = phrases.find_phrases(read(spark, sf, "documents"), flag_phrases(spark, sf), "doc_id")
    own = found.groupBy("doc_id", "category").agg(F.max("weight").alias("weight"), F.count("*").alias("hits"))
    return own.groupBy("doc_id").agg(F.least(F.lit(100.0), F.sum(F.col("weight") * F.least("hits", F.lit(5))) / F.lit(20.0)).alias("score"), F.count("*").alias("categories"))


@query("SELECT doc_id, 'that' AS keyword FROM documents WHERE contains(lower(text), 'that') UNION ALL SELECT doc_id, 'With the ' FROM documents WHERE contains(lower(text), 'with the ') UNION ALL SELECT doc_id, 'REWH' FROM documents WHERE contains(lower(text), 'rewh')", with_roles=False)
def keyword_index_search(spark, sf):
    """Documents that contain a word, a part of a word or a phrase, found through an index of postings."""
    texts, path = read(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "keyword-index")
    index.write_index(texts, "doc_id", path)
    found = [index.containing(texts, "doc_id", path, k).select(F.col("key").alias("doc_id"), F.lit(k).alias("keyword")) for k in ("that", "With the ", "REWH")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH u AS (SELECT c_custkey AS k, coalesce(s_name, c_name) AS name, c_acctbal AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))
SELECT * FROM u UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_partkey NOT IN (SELECT k FROM u)""", with_roles=False)
def stored_table_changes(spark, sf):
    """A stored table after an upsert and an insert of new keys, each of which rewrote the folders that it touched."""
    own = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    path = scratch(spark, "stored")
    stored.create(own, ["k"], path, 16)
    new = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    stored.change(spark, path, own.schema, ["k"], new, lambda a, b: changes.upsert(a, b, ["k"]), 16)
    more = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    stored.change(spark, path, own.schema, ["k"], more, lambda a, b: changes.insert_or_ignore(a, b, ["k"]), 16)
    return stored.read(spark, path, own.schema)
