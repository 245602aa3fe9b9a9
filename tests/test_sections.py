"""Item sections against a plain loop; texts are cut within their rows."""

import random
import re

from deltascope.operators import segment


def plain(text, form):
    lines = [re.sub("[ \t\r ]+", " ", x).strip(" ") for x in text.split("\n")]
    out, part = [], None
    for no, line in enumerate(lines):
        m, p = re.match(segment.ITEM_LINE, line), re.match(segment.PART_LINE, line)
        part = p[1].upper() if p else part
        if m:
            item = m[1].upper()
            out.append([no, f"P{['I', 'II', 'III', 'IV'].index(part) + 1}I{item}" if form == "10-Q" and part else item, []])
        elif out:
            out[-1][2].append(line)
    return [(no, key, re.sub("^[ \n]+|[ \n]+$", "", re.sub("\n{3,}", "\n\n", "\n".join(x)))) for no, key, x in out]


def test_item_sections(spark):
    rng = random.Random(2)
    lines = ["Item 1. Business", "item 1A: Risks", "Item 7.", "PART I", "part ii. Other", "words of a text", "", "more  words", "Items 1", "12"]
    docs = [(i, rng.choice(["10-K", "10-Q"]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc long, form string, text string")
    for keep, least in (("every", 0), ("longest", 5), ("last", 0)):
        want = []
        for doc, form, text in docs:
            own = plain(text, form)
            rows = [x for x in own if len(x[2]) > least] if least else own
            if keep == "longest":
                rows = [max((x for x in rows if x[1] == k), key=lambda x: (len(x[2]), -x[0])) for k in {x[1] for x in rows}]
            if keep == "last":
                rows = [max(x for x in rows if x[1] == k) for k in {x[1] for x in rows}]
            want += [(doc, *x) for x in rows]
        out = segment.item_sections(df, keep=keep, least=least)
        assert sorted((r.doc, r.section, r.key, r.text) for r in out.where("key <> '0'").collect()) == sorted(want)
        assert "Exchange" not in out._jdf.queryExecution().toString()  # no text is shuffled, no line is a row


def test_named_sections_within_their_rows(spark):
    rng = random.Random(4)
    lines = ["Item 1A - Risk Factors", "see item 1a: risk factors and Item 8. Financial Statements here", "Item 7 Management's Discussion", "words of a text", "", "  more  words ", "an item of note", "Item 8 financial"]
    docs = [(i, "8-K", "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(150)] + [(200, "8-K", None)]
    want = []
    for doc, form, text in docs[:-1]:
        heads, start = [], 0
        for line in text.split("\n"):
            heads += sorted((start + m.start(), name) for name, p in segment.NAMED.items() if (m := re.search(p, line.lower())))
            start += len(line) + 1
        own = {}
        for (a, name), (b, _) in zip(heads, [*heads[1:], (len(text), "")]):
            x = text[a:b].strip(" \t\n\r\f\v")
            if len(x) > 30:
                own[name] = x
        want += [(doc, n, n.upper().replace("_", " "), x) for n, x in own.items()] or [(doc, "full", "FULL FILING", text)]
    out = segment.named_sections(spark.createDataFrame(docs, "doc long, form string, text string"), least=30)
    assert sorted((r.doc, r.name, r.label, r.text) for r in out.collect()) == sorted(want)
    assert "Exchange" not in out._jdf.queryExecution().toString()  # no text is shuffled, no line is a row
