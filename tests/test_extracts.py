"""Tables and phrases against hand-made rows and plain loops."""

import random
import re

from deltascope.operators import phrases, tables


def test_tables_with_spans_and_nesting():
    page = """<p>x</p><table><tr><td></td></tr><tr><th rowspan=2>Year</th><th colspan="2">Sales</th></tr><tr><td>Q1<td>Q2</tr>
      <tr><td>2024</td><td> 1,000&nbsp;</td><td>2 <b>000</b><br>net</td></tr><tr><td>note<table><tr><td>in</td><td>side</td></tr></table></td></tr><tr></tr></table>
      <script><table><tr><td>no</td></tr></table></script><table><tr><td> </td></tr></table><table><tr><td>a</td><td>b</td><td>c</td><tr><td>1<td rowspan=3>2<tr><td>3<tr><td>4<td>5<td>6"""
    assert tables.tables_of(page) == [
        {"parent": -1, "headers": ["Year", "Sales", "Sales"], "rows": [["Year", "Q1", "Q2"], ["2024", "1,000", "2 000 net"], ["note [TABLE]"]]},
        {"parent": 0, "headers": ["in", "side"], "rows": []},
        {"parent": -1, "headers": ["a", "b", "c"], "rows": [["1", "2"], ["3", "2"], ["4", "2", "5", "6"]]}]
    assert tables.tables_of(None) == tables.tables_of("") == tables.tables_of("<table><tr><td></table>") == []
    assert tables.tables_of("<table><tr><td colspan=x rowspan=0>a<td colspan='99999'>b</table>")[0]["headers"] == ["a"] + ["b"] * 1000


def test_table_cells(spark):
    rows = [(1, "<table><tr><th>a<tr><td>1<td>2</table>"), (1, "<table><tr><th>a<tr><td>1<td>2</table>"), (2, None), (3, "none")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "id long, page string, value string")
    got = sorted(map(str, map(tuple, tables.table_cells(frame, "id", "page").collect())))
    assert got == [str((1, 0, -1, 0, 0, "a", "1"))] * 2 + [str((1, 0, -1, 0, 1, None, "2"))] * 2
    assert tables.table_cells(frame.limit(0), "id", "page").count() == 0


def test_phrases(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("ab cd ef gh".split()) + rng.choice(["", ",", ".\n", " 7"]) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, "")]
    table = [(c, " ".join(rng.choice("AB cd ef gh zz".split()) for _ in range(rng.randrange(1, 4))), rng.randrange(9)) for c in range(14) for _ in range(4)] + [(3, "  ", 1), (5, None, 1), (2, "ab", 1), (2, "AB!", 7)]
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame(table, "category int, phrase string, weight int")
    want, hits = set(), {}
    for i, text in texts:
        w = re.findall("[a-z]+", (text or "").lower())
        for c in range(14):
            own = {}
            for k, phrase, weight in table:
                q = tuple(re.findall("[a-z]+", (phrase or "").lower()))
                if k == c and q:
                    own[q] = max(own.get(q, 0), weight)
            for q, weight in own.items():
                for at in range(len(w) - len(q) + 1):
                    if tuple(w[at : at + len(q)]) == q:
                        want.add((i, c, " ".join(q), weight, at + 1))
    for most in (32 << 20, 0):
        found = phrases.find_phrases(t, p, "id", most_bytes=most)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 300
    for r in phrases.category_hits(t, phrases.find_phrases(t, p, "id"), "id", 3, 10, 20).collect():
        own = sorted((x[4], x[2]) for x in want if x[0] == r.id and x[1] == r.category)
        w = re.findall("[a-z]+", dict(texts)[r.id].lower())
        prose = " ".join(w)
        ats = [len(" ".join(w[: a - 1])) + (a > 1) for a, _ in own[:3]]
        assert r.hits == len(own) and r.excerpts == [prose[max(0, a - 10) : a + 20] for a in ats]
    assert phrases.find_phrases(t, p.limit(0), "id").count() == 0


def test_texts_meet_phrases_by_two_words_and_categories_at_once(spark):
    t = spark.createDataFrame([(1, "The old, Old house of the old house"), (2, "old"), (3, None), (4, "house the old house")], "id long, text string")
    p = spark.createDataFrame([("a", "old house", 3), ("a", "the old house", 5), ("b", "the old", 1)], "category string, phrase string, weight int")
    found = phrases.find_phrases(t, p, "id")
    assert "p1#" in found._jdf.queryExecution().optimizedPlan().toString()  # common first words alone make no rows
    assert sorted((r.id, r.phrase, r.at) for r in found.collect()) == [(1, "old house", 3), (1, "old house", 7), (1, "the old", 1), (1, "the old", 6), (1, "the old house", 6), (4, "old house", 3), (4, "the old", 2), (4, "the old house", 2)]
    out = phrases.category_hits(t, found, "id", 2, 4, 9)
    assert "slice" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]  # no word list is cut for an excerpt
    assert sorted((r.id, r.category, r.hits, r.weight, r.excerpts) for r in out.collect()) == [
        (1, "a", 3, 5, ["old old house", " of the old h"]), (1, "b", 2, 1, ["the old o", " of the old h"]),
        (4, "a", 2, 5, ["use the old h", "the old house"]), (4, "b", 1, 1, ["use the old h"])]
