"""Common words of two versions within their row against plain loops; no word is shuffled."""

import random
from collections import Counter

import numpy as np

from deltascope.operators import align, matching, overlap


def paragraph(rng):
    return " ".join(rng.choice(["aa", "b", "cc", "d", "ee", "f"]) for _ in range(rng.randrange(0, 7)))


def test_products_in_small_blocks():
    rng = random.Random(1)
    for cells in (1, 7, 50, 10_000):
        for _ in range(20):
            new, old = [[paragraph(rng).split() for _ in range(rng.randrange(0, 6))] for _ in range(2)]
            rows, terms, times = overlap.incidence([*new, *old])
            got = np.zeros((len(new), len(old)))
            for i, block in overlap.products(rows, terms, times, len(new), len(old), cells):
                got[i : i + len(block)] += block
            want = [[sum(Counter(a)[w] * c for w, c in Counter(b).items()) for b in old] for a in new]
            assert got.tolist() == want


def test_greedy_versions_equals_matching_by_joins(spark):
    rng = random.Random(5)
    docs = [(k, [paragraph(rng) for _ in range(rng.randrange(0, 9))], [paragraph(rng) for _ in range(rng.randrange(0, 9))]) for k in range(40)] + [(99, None, ["a"]), (100, [], [])]
    own = spark.createDataFrame(docs, "key long, new array<string>, old array<string>")
    flat = [(k, mark, i, p.split()) for k, *sides in docs for mark, ps in zip("no", sides) for i, p in enumerate(ps or [])]
    want = matching.greedy_matching(spark.createDataFrame(flat, "key long, side string, at long, toks array<string>"))
    out = matching.greedy_versions(own)
    rows = lambda df: sorted((r.key, r.change, r.new_at, r.old_at, round(r.score, 9)) for r in df.collect())
    assert rows(out) == rows(want) and len({r[1] for r in rows(out)}) == 4


def test_no_word_is_a_row(spark):
    own = spark.createDataFrame([(1, ["a b c d"], ["a b c e"])], "key long, new array<string>, old array<string>")
    found = overlap.bag_pairs(own, 0.5)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert [(r.kind, r.a, r.b) for r in found.collect()] == [("n", 0, 0), ("o", 0, 0), ("p", 0, 0)]
    (score,) = [s for _, _, _, s in align.greedy_pairs(["a b c d"], ["a b c e"])]
    assert abs([r.s for r in found.collect()][-1] - score) < 1e-12


def test_cosine_pairs_equal_a_plain_loop(spark):
    rng = random.Random(8)
    docs = [(k, [paragraph(rng) for _ in range(rng.randrange(0, 7))], [paragraph(rng) for _ in range(rng.randrange(0, 7))]) for k in range(30)]
    out = overlap.cosine_pairs(spark.createDataFrame(docs, "key long, new array<string>, old array<string>"), 0.5)
    assert "Exchange" not in out._jdf.queryExecution().toString()  # no word is a row
    want = set()
    for k, new, old in docs:
        vectors = align._vectors([p.split() for p in [*new, *old]])
        for i, a in enumerate(vectors[: len(new)]):
            for j, b in enumerate(vectors[len(new) :]):
                size = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
                s = sum(x * b.get(t, 0.0) for t, x in a.items()) / size if size else 0.0
                if s >= 0.5 + 1e-9:
                    want.add((k, i, j, round(s, 9)))
    assert want <= {(r.key, r.new_at, r.old_at, round(r.cosine, 9)) for r in out.collect()}
    assert len(want) + sum(r.cosine < 0.5 + 1e-9 for r in out.collect()) == out.count() and want


def test_best_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    for _ in range(200):
        new, old = [[overlap.wording(paragraph(rng)) for _ in range(rng.randrange(0, 6))] for _ in range(2)]
        s, r = overlap.best_overlaps(new, old)
        assert s.tolist() == [max((share(a, b) for b in old), default=0.0) for a in new]
        assert r.tolist() == [max((share(a, b) for a in new), default=0.0) for b in old]
    assert overlap.wording("a 12 b 3x 4.5 a") == ["a", "#", "b", "#x"]
    # 600 by 600 different sets
    text = "\n".join(" ".join(f"w{chr(97 + k % 26)}{chr(97 + (k + i * i) % 26)}{chr(97 + i % 26)}" for k in range(40)) for i in range(600))
    out = align.section_change(spark.createDataFrame([(text, text.replace("wa", "va")), (None, "a"), ("", "")], "old_text string, new_text string")).collect()
    assert out[0].paragraphs == 600 and (out[1].paragraphs, out[1].removed) == (0, None) and out[2].change_ratio == 0.0
