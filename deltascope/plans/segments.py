"""Filings cut into sections; documents stand for the bodies of annual and quarterly filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment
from ..sources.tables import read
from .base import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: Lines of an annual filing around the text T, with a table of contents, running heads and a reference to the exhibits.
ANNUAL = ["Item 1A. Risk Factors 12", "Item 7. Management's Discussion 40", "PART I", "Item 1A. Risk Factors", "T", "12", "PART I", "Item 1A.", "and so on", "PART II", "Item 7. Management's Discussion and Analysis", "In short: T", "Item 8. Financial Statements", "See Item 15 for the statements, which are part of this report.", "PART IV", "Item 15. Exhibits", "Statements: T"]
#: Lines of a quarterly filing whose body has no part headings.
QUARTERLY = ["PART I. FINANCIAL INFORMATION", "Item 1. Financial Statements (page 3)", "PART II. OTHER INFORMATION", "Item 1A. Risk Factors (page 9)", "Item 1. Financial Statements", "T", "Item 2. Management's Discussion and Analysis", "In short: T", "Item 3. Quantitative and Qualitative Disclosures About Market Risk", "There were no material changes to what we stated in the last annual report.", "Item 1A. Risk Factors", "Risks: T"]


def filing_texts(spark, sf):
    """(doc, form, text): every document as the body of a filing."""
    body = F.coalesce("text", F.lit(""))
    text = lambda lines: F.concat_ws("\n", *[F.concat(F.lit(x[:-1]), body) if x.endswith("T") else F.lit(x) for x in lines])
    form = F.element_at(F.array(*[F.lit(x) for x in ("10-K", "10-Q", "10-K/A")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), form.alias("form"), F.when(form == "10-Q", text(QUARTERLY)).otherwise(text(ANNUAL)).alias("text"))


def _sql_text(lines: list[str]) -> str:
    quoted = ["'" + (x[:-1] if x.endswith("T") else x).replace("'", "''") + "'" + (" || t" if x.endswith("T") else "") for x in lines]
    return " || chr(10) || ".join(quoted)


SQL = rf"""WITH f AS (
  SELECT doc, form, CASE WHEN form = '10-Q' THEN {_sql_text(QUARTERLY)} ELSE {_sql_text(ANNUAL)} END AS text
  FROM (SELECT doc_id AS doc, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '10-K/A' END AS form, coalesce(text, '') AS t FROM documents)),
l AS (
  SELECT doc, form, unnest(range(len(parts))) AS no, trim(regexp_replace(unnest(parts), '[ \t\r\x{{a0}}]+', ' ', 'g')) AS line
  FROM (SELECT doc, form, string_split(text, chr(10)) AS parts FROM f)),
m AS (
  SELECT doc, form, CAST(no AS INTEGER) AS no, line, nullif(upper(regexp_extract(line, '^item (\d{{1,2}}[a-c]?)(?:[ .:\-\x{{2013}}\x{{2014}}]+([^\d .:\-\x{{2013}}\x{{2014}}].*)?)?$', 1, 'i')), '') AS item,
    regexp_extract(line, '^item (\d{{1,2}}[a-c]?)(?:[ .:\-\x{{2013}}\x{{2014}}]+([^\d .:\-\x{{2013}}\x{{2014}}].*)?)?$', 2, 'i') AS title,
    nullif(upper(regexp_extract(line, '^part (iv|iii|ii|i)(?:[ .,:\-\x{{2013}}\x{{2014}}].{{0,100}})?$', 1, 'i')), '') AS part,
    regexp_matches(line, '^(?:part [ivx]+\.?|item \d{{1,2}}[a-c]?\.?|(?:page )?\d{{1,3}})$', 'i') AS running FROM l),
w AS (SELECT *, last_value(part IGNORE NULLS) OVER (PARTITION BY doc ORDER BY no) AS within FROM m)"""

TIDY = r"regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY no), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(SQL + rf""",
a AS (SELECT *, CASE WHEN item IS NULL THEN NULL WHEN form <> '10-Q' THEN item ELSE coalesce(CASE
    WHEN item = '1' AND lower(title) LIKE '%financial%' OR item = '2' AND lower(title) LIKE '%management%' OR item = '3' AND lower(title) LIKE '%market%' OR item = '4' AND lower(title) LIKE '%controls%' THEN 'I'
    WHEN item = '1' AND lower(title) LIKE '%legal%' OR item = '1A' AND lower(title) LIKE '%risk%' OR item = '2' AND lower(title) LIKE '%unregistered%' OR item = '3' AND lower(title) LIKE '%defaults%'
      OR item = '4' AND lower(title) LIKE '%mine%' OR item = '5' AND lower(title) LIKE '%other%' OR item = '6' AND lower(title) LIKE '%exhibits%' THEN 'II' END, within, '') || '/' || item END AS place FROM w),
b AS (SELECT *, lag(place) OVER (PARTITION BY doc, place IS NULL ORDER BY no) AS place0, lag(part) OVER (PARTITION BY doc, part IS NULL ORDER BY no) AS part0 FROM a),
c AS (SELECT *, place IS NOT NULL AND place IS DISTINCT FROM place0 OR part IS NOT NULL AND part IS DISTINCT FROM part0 AS opens FROM b),
d AS (SELECT doc, form, no, line, running, last_value(CASE WHEN opens THEN no END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY no) AS section,
             last_value(CASE WHEN opens THEN coalesce(place, '') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY no) AS place FROM c),
e AS (SELECT doc, form, section, place, {TIDY} AS text FROM d WHERE no > section AND NOT running AND place <> '' GROUP BY ALL),
k(place, quarterly, key, item, title) AS (VALUES ('1A', false, 'risk_factors', 'Item 1A', 'Risk Factors'), ('7', false, 'mdna', 'Item 7', 'Management''s Discussion and Analysis'), ('7A', false, 'market_risk', 'Item 7A', 'Market Risk'), ('8', false, 'financial_statements', 'Item 8', 'Financial Statements'),
  ('15', false, 'exhibits', 'Item 15', 'Financial Statements'), ('II/1A', true, 'risk_factors', 'Part II, Item 1A', 'Risk Factors'), ('I/2', true, 'mdna', 'Part I, Item 2', 'Management''s Discussion and Analysis'), ('I/3', true, 'market_risk', 'Part I, Item 3', 'Market Risk'), ('I/1', true, 'financial_statements', 'Part I, Item 1', 'Financial Statements')),
g AS (SELECT doc, form, key, item, title, text FROM e JOIN k ON e.place = k.place AND quarterly = (form = '10-Q') QUALIFY row_number() OVER (PARTITION BY doc, key ORDER BY length(text) DESC, section) = 1),
x AS (SELECT doc, form, text AS spare FROM g WHERE key = 'exhibits'),
y AS (SELECT doc, form, text AS stated FROM g WHERE key = 'financial_statements'),
z AS (SELECT coalesce(x.doc, y.doc) AS doc, coalesce(x.form, y.form) AS form, stated, spare, coalesce(length(spare) > coalesce(length(stated), 0), false) AND coalesce(length(stated), 0) < 1000 AS refers FROM x FULL JOIN y ON x.doc = y.doc),
r AS (SELECT doc, form, key, item, title, text FROM g WHERE key NOT IN ('exhibits', 'financial_statements') UNION ALL
      SELECT doc, form, 'financial_statements', CASE WHEN refers THEN 'Item 15 (referenced from Item 8)' WHEN form = '10-Q' THEN 'Part I, Item 1' ELSE 'Item 8' END, 'Financial Statements', CASE WHEN refers THEN spare ELSE stated END FROM z)
SELECT doc, form, key, item, title, text, length(text) AS char_count FROM r WHERE length(text) >= 60""", with_roles=False)
def target_sections(spark, sf):
    """The four wanted sections of annual and quarterly filings."""
    return segment.target_sections(filing_texts(spark, sf))


_ITEMS = SQL + rf""",
c AS (SELECT *, last_value(CASE WHEN item IS NOT NULL THEN no END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY no) AS section FROM w),
h AS (SELECT doc, form, no AS section, CASE WHEN form = '10-Q' AND within IS NOT NULL THEN 'P' || length(replace(within, 'IV', 'IIII')) || 'I' || item ELSE item END AS key,
        'Item ' || item || CASE WHEN title = '' THEN '' ELSE ' ' || chr(8212) || ' ' || title END AS label, left(title, 200) AS title FROM c WHERE item IS NOT NULL),
e AS (SELECT doc, section, {TIDY} AS text FROM c WHERE no > section GROUP BY ALL),
r AS (SELECT h.*, coalesce(e.text, '') AS text FROM h LEFT JOIN e ON h.doc = e.doc AND h.section = e.section)
"""


@query(_ITEMS + "SELECT * FROM r", with_roles=False)
def every_item_section(spark, sf):
    """Every item heading with its text."""
    return segment.item_sections(filing_texts(spark, sf))


@query(_ITEMS + "SELECT * FROM r WHERE length(text) > 100 QUALIFY row_number() OVER (PARTITION BY doc, key ORDER BY length(text) DESC, section) = 1", with_roles=False)
def longest_item_section(spark, sf):
    """The longest text of each item, of more than 100 characters."""
    return segment.item_sections(filing_texts(spark, sf), keep="longest", least=100)


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), 'item', 'unit', 'gi'), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') AS t FROM documents)
SELECT doc_id AS doc, '8-K' AS form, v.name, v.label, v.text FROM f, LATERAL (VALUES
  ('item_1a', 'ITEM 1A', 'Item 1A - Risk Factors' || chr(10) || t || chr(10) || 'Now'), ('item_8', 'ITEM 8', 'Item 8. Financial Statements: ' || t)) v(name, label, text)
WHERE length(t) > 200
UNION ALL SELECT doc_id, '8-K', 'full', 'FULL FILING', t FROM f WHERE length(t) <= 200""", with_roles=False)
def named_heading_sections(spark, sf):
    """Sections by named headings; long texts (whose own items are renamed) get two, one in mid-line, short ones have none."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)item", "unit"), r"^\s+|\s+$", "")
    text = F.when(F.length(t) > 200, F.concat(F.lit("Item 1A - Risk Factors\n"), t, F.lit("\nNow Item 8. Financial Statements: "), t)).otherwise(t)
    return segment.named_sections(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lit("8-K").alias("form"), text.alias("text")))
