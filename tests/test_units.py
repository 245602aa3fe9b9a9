"""Operators on small cases with known answers."""

import datetime

from pyspark.sql import functions as F

from deltascope.functions import scores
from deltascope.functions import text as T
from deltascope.operators import align, changes, segment, temporal
from deltascope.sources import feeds, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_unified_score_values(spark):
    rows = [(.95, .05, 1, 100.0, "CRITICAL"), (.10, .90, 20, 0.0, "NOISE"), (.80, .0, 0, 100.0, "CRITICAL"), (.65, .70, 20, 80.75, "CRITICAL"), (.30, .60, 25, 40.54, "MEDIUM"), (.20, .65, 15, 29.2, "LOW"), (.15, .50, 8, 17.26, "NOISE")]
    df = spark.createDataFrame(rows, "m double, q double, n int, score double, rank string")
    got = df.select("score", "rank", *[c.alias("got_" + k) for k, c in scores.unified_score(F.col("m"), F.col("q"), F.col("n")).items()]).collect()
    for r in got:
        assert (r["got_score"], r["got_rank"]) == (r["score"], r["rank"])


def test_asof_strict_ties_and_forward(spark):
    left = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, t int, v string")
    back = {(r.k, r.t): r.v for r in temporal.asof_backward(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert back == {("a", 5): "x", ("a", 3): None, ("b", 1): None}
    assert {(r.k, r.t): r.v for r in temporal.asof_forward(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5): "y", ("a", 3): "x", ("b", 1): None}


def test_throttle_counts_from_last_sent(spark):
    assert one(spark, temporal.throttle(F.array(*[F.lit(float(x)) for x in (0, 4, 7, 11, 13)]), 6.0)) == [0.0, 7.0, 13.0]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, made int")
    new = spark.createDataFrame([(2, "", 9), (3, "c", 3)], "k int, name string, made int")
    got = {r.k: (r.name, r.made) for r in changes.upsert(old, new, ["k"], keep_if_empty=["name"], keep=["made"]).collect()}
    assert got == {1: ("a", 1), 2: ("b", 2), 3: ("c", 3)}


def test_text_measures(spark):
    assert one(spark, F.size(T.words(F.lit("")))) == 0
    assert one(spark, T.edit_ratio(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, T.keyword_density(F.lit("fraud fraud fraud fraud"), {"fraud": 3.0})) == 1.0
    assert one(spark, T.clip(F.lit("alpha beta gamma delta"), 15)) == "alpha beta..."
    good = one(spark, T.sentiment(T.tokens(F.lit("strong growth")), ["growth", "strong"], ["loss"], ["not"]))
    assert good > one(spark, T.sentiment(T.tokens(F.lit("not strong growth")), ["growth", "strong"], ["loss"], ["not"]))


def test_section_change_counts(spark):
    base = " ".join(f"word{chr(97 + i)}" for i in range(20))
    old = base + "\n" + " ".join(f"old{chr(97 + i)}" for i in range(20))
    new = base.replace("worda", "wordz") + "\n" + " ".join(f"new{chr(97 + i)}" for i in range(20))
    r = align.section_change(spark.createDataFrame([(old, new)], "old_text string, new_text string")).first()
    assert (r["paragraphs"], r["added"], r["modified"], r["removed"], r["change_ratio"]) == (2, 1, 0, 1, 0.667)


def test_greedy_and_opcodes():
    new, old = ["alpha beta gamma", "brand new words"], ["alpha beta gamma", "gone from here"]
    assert {x[0] for x in align.greedy_pairs(new, old)} == {"unchanged", "added", "removed"}
    assert [x[0] for x in align.opcode_pairs(["a", "b"], ["a"])] == ["unchanged", "added"]
    assert align.greedy_pairs([], []) == [] and align.char_ratio("", "") == 1.0
    assert align.word_diff("a b c", "a x c") == [("equal", "a"), ("removed", "b"), ("added", "x"), ("equal", "c")]


FILLER = "The company sells widgets in many markets and expects demand to go on for some more years to come. " * 3


def cut(spark, text, form):
    df = spark.createDataFrame([(1, form, text)], "doc long, form string, text string")
    got = {r.key: r for r in segment.target_sections(df).collect()}
    return {k: got[k] for k in segment.ORDER if k in got}


def test_sections_of_annual_form(spark):
    text = f"Item 1A. Risk Factors\nItem 7. MD&A\nItem 8. Financial Statements\nPART I\nItem 1A. Risk Factors\nRISK {FILLER}\nPART II\nItem 7. Discussion\nMDNA {FILLER}\nItem 8. Financial Statements\nSee item 15 for these statements, which are part of this report here.\nItem 15. Exhibits\nFS {FILLER}"
    got = cut(spark, text, "10-K/A")
    assert list(got) == ["risk_factors", "mdna", "financial_statements"]
    assert got["risk_factors"].text.startswith("RISK") and got["financial_statements"]["item"] == "Item 15 (referenced from Item 8)" and got["mdna"].text.strip() == f"MDNA {FILLER}".strip()
    assert cut(spark, text, "8-K") == {} and cut(spark, None, "10-K") == {}


def test_sections_of_quarterly_form_take_part_from_title(spark):
    text = f"PART II\nItem 1. Financial Statements\nFS {FILLER}\nItem 2. Management's Discussion and Analysis\nM {FILLER}\nItem 3. Market risk\nThere have been no material changes to our market risk since the 10-K.\nItem 1A. Risk Factors\nR {FILLER}"
    got = cut(spark, text, "10-Q")
    assert [x["item"] for x in got.values()] == ["Part II, Item 1A", "Part I, Item 2", "Part I, Item 3", "Part I, Item 1"]


def test_running_heads_do_not_cut_sections(spark):
    pages = "".join(f"page text {i} {FILLER}\n37\nPART II\nItem 7\n" for i in range(4))
    got = cut(spark, f"PART II\nItem 7. Discussion\n{pages}the end\nItem 7A. Market Risk\nMARKET {FILLER}", "10-K")
    text = got["mdna"].text
    assert text.startswith("page text 0") and text.endswith("the end") and "PART II" not in text and "37" not in text and got["market_risk"].text.startswith("MARKET")


def test_item_sections_without_headings(spark):
    df = spark.createDataFrame([(1, "10-K", "first line\nsecond"), (2, "10-K", ""), (3, "8-K", "Item 5.02 Departure\nx"), (4, "10-K", None)], "doc long, form string, text string")
    assert [(r.doc, r.key, r.title, r.text) for r in segment.item_sections(df).orderBy("doc").collect()] == [(1, "0", "first line", "first line\nsecond"), (3, "0", "Item 5.02 Departure", "Item 5.02 Departure\nx")]
    assert segment.item_sections(df, clip=5).orderBy("doc").first().text == "first"


def test_html_readers():
    page = "<html><head><title>t</title></head><body><p>One <b>two</b><br>three<div style='display: none'>no</div><table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table><script>x</script></body>"
    assert "no" not in segment.html_to_text(page).split() and "One two\nthree" in segment.html_to_text(page)
    text, tables = segment.html_with_tables(page)
    assert "[TABLE]" in text and tables == [{"headers": ["a", "b"], "rows": [["1", "2"]]}]
    assert segment.html_to_text(None) == ""
    text, _ = segment.html_with_tables("<p>“Quoted” — ﬁnal</p><!-- gone --><p>12</p><p>....... 3</p><p>page 4</p>")
    assert text.split() == ['"Quoted"', "-", "final"]


def test_submissions_feed(spark):
    recent = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>,items:array<string>,size:array<bigint>>"
    row = {"cik": "1045810", "filings": {"recent": {"accessionNumber": ["000104581025000023", "0001045810-25-000100", "bad"], "form": ["10-K", "10-K/A", "4"], "filingDate": ["2025-02-26", "2025-06-02"], "reportDate": ["2025-01-26"], "acceptanceDateTime": [], "primaryDocument": ["a.htm", "b.htm", "xslF345X05/c.xml"], "primaryDocDescription": None, "items": ["", "5.02,9.01"], "size": [1]}}}
    df = spark.createDataFrame([row], f"cik string, filings struct<recent:{recent}>")
    rows = feeds.submissions(df)
    got = {r.document: r for r in rows.collect()}
    assert got["a.htm"].accession == "0001045810-25-000023" and got["c.xml"].accession is None and got["b.htm"].is_amendment
    assert got["b.htm"]["items"] == ["5.02", "9.01"]
    assert [r.form for r in feeds.select_filings(rows, ["10-K"]).collect()] == ["10-K/A", "10-K"]


def test_universe_and_tickers(spark):
    rows = spark.createDataFrame([(1, "A", "AAPL", "Nasdaq"), (1, "A", "AAPL", "OTC"), (2, "B", "BRK-B", "NYSE"), (3, "T", "TINY", None), (4, "x", None, "NYSE")], "cik long, name string, ticker string, exchange string")
    assert [r.ticker for r in feeds.universe(rows).collect()] == ["BRK-B", "AAPL", "TINY"]
    recs = spark.createDataFrame([(2, "brk.b", "B"), (9, "BRK-B", "C")], "cik_str long, ticker string, title string")
    assert [tuple(r) for r in feeds.ticker_map(recs).collect()] == [("BRK-B", "0000000002", 2, "B")]


def test_feeds_and_sinks(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>urn:0001045810-25-000023</id><title>10-K - NVIDIA CORP (0001045810) (Filer)</title><updated>2025-02-26T10:00:00Z</updated><summary>s</summary></entry></feed>")
    r = feeds.feed_entries(spark, str(tmp_path / "f.xml")).first()
    assert (r.form, r.company, r.cik, r.accession) == ("10-K", "NVIDIA CORP", 1045810, "0001045810-25-000023")
    (tmp_path / "n.xml").write_text("<rss><channel><item><title>T</title><link>http://x</link><pubDate>Wed, 26 Feb 2025 10:00:00 GMT</pubDate><description>&lt;b&gt;hi&lt;/b&gt;</description></item></channel></rss>")
    n = feeds.news_items(spark, str(tmp_path / "n.xml")).first()
    assert n.published == datetime.datetime(2025, 2, 26, 10) and n.summary == "hi"
    df = spark.createDataFrame([(1, ["a", "b"], None)], "i int, l array<string>, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(x) for x in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("1", "a, b", None)]
    assert one(spark, sinks.ascii_json(F.struct(F.lit("é").alias("a")))) == '{"a":"\\u00e9"}'


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_ratio_of_whole_texts(spark):
    same = "".join(chr(0x4E00 + i % 20_000) for i in range(50_000))
    df = spark.createDataFrame([(same + "x" * 500, same + "y" * 500), (same, same)], "old string, new string")
    assert [r[0] for r in df.select(align.text_ratio()("old", "new")).collect()] == [100_000 / 101_000, 1.0]


def test_stored_documents_and_filters(spark):
    docs = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None)], "accession long, content string")
    stored = spark.createDataFrame([("x",)], "content string").select(F.sha2("content", 256).alias("sha256"))
    assert sorted(r.accession for r in sinks.store_documents(docs, stored).collect() if r.content) == [1, 3]


def test_three_crawls(spark):
    """New accessions only; an error is tried again; an amendment changes no more than versions."""
    def crawl(stored, feed):
        new = feed.join(stored.where("status = 'fetched'").select("accession"), "accession", "left_anti")
        return changes.upsert(stored, new, ["accession"], keep=["first"]), new.count()

    kind = "accession long, status string, first int, version int"
    stored = spark.createDataFrame([], kind)
    stored, n = crawl(stored, spark.createDataFrame([(1, "fetched", 1, 1), (2, "error", 1, 1), (3, "fetched", 1, 1)], kind))
    assert n == 3
    stored, n = crawl(stored, spark.createDataFrame([(1, "fetched", 2, 9), (2, "fetched", 2, 1), (3, "fetched", 2, 9)], kind))
    assert n == 1
    stored, n = crawl(stored, spark.createDataFrame([(4, "fetched", 3, 2)], kind))
    assert n == 1 and {r.accession: (r.status, r["first"], r.version) for r in stored.collect()} == {1: ("fetched", 1, 1), 2: ("fetched", 1, 1), 3: ("fetched", 1, 1), 4: ("fetched", 3, 2)}


def test_watched_and_replayed_batches(spark, tmp_path):
    from deltascope.streaming import monitor

    own = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert monitor.watched(own, own.limit(0).select("k"), "k").count() == 2
    assert [r.v for r in monitor.watched(own, own.where("k = 'b'").select("k"), "k").collect()] == [2]
    own.write.parquet(str(tmp_path / "in"))
    stream = monitor.read_stream(spark, str(tmp_path / "in"), "k string, v int", files=1)
    write = lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))
    monitor.run(stream, write, str(tmp_path / "state")).awaitTermination()
    write(own, 0)  # the first batch runs again
    assert spark.read.parquet(str(tmp_path / "out/batch=0")).count() == 2


def test_configuration_tree():
    import pytest

    from deltascope import config

    tree = config.load({"scores": {"gap": 0.1, "burial": 0.4}, "feeds": {"limit": 5}})
    assert tree["feeds"] == {"limit": 5, "keep_days": 1} and config.DEFAULTS["feeds"]["limit"] == 200
    assert config.errors({"feeds": {"limit": 0}}) == ["feeds.limit", "feeds.keep_days", "throttle.hours", "scores", "cache_days"]
    with pytest.raises(ValueError, match="scores"):
        config.load({"scores": {"gap": 0.9}})


def test_named_heading_patterns():
    import re

    from deltascope.operators.segment import NAMED, TITLES

    for number, title in TITLES.items():
        for line in (f"Item {number}. {title}", f"ITEM  {number} - {title.upper()}", f"see item {number}: {title.lower()}"):
            hits = [k for k, p in NAMED.items() if re.search(p, line.lower())]
            assert hits == [f"item_{number.lower()}"], (line, hits)
    for line in ("item 1", "item 10a. directors", "items 7 and 8", "item 21. business", "item 7. " + "x" * 100 + " management"):
        assert not any(re.search(p, line) for p in NAMED.values())
