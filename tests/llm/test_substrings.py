"""Repeated passages against brute force."""

import random
import re

import numpy as np

from deltascope.llm import substrings


def brute(rows, window=50):
    first = {}
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            if i is not None:
                s = tuple(w[k : k + window])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), [(k, next(e for e in range(k, len(w) + 1) if e not in gone) - k) for k in spans]))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [tuple(s) for s in r["repeats"]]) for r in substrings.remove_repeats(frame, **options).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([24, 25, 49, 50, 51, 60, 75, 140]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += [word() for _ in range(rng.randrange(0, 60))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                w += p[rng.randrange(0, 3) : len(p) - rng.randrange(0, 3)]
        rows.append((rng.randrange(n * 2), " ".join(w) if w else rng.choice(["", None])))
        if rng.random() < 0.2:
            rows.append((rng.randrange(n * 2), rows[rng.randrange(len(rows))][1]))
    return rows


SCHEMA = "doc_id long, text string, row string, starts int"


def test_brute_force(spark):
    for seed, buckets in ((1, 500_000), (2, 40)):
        rows = corpus(seed, 120)
        frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
        want = brute(rows)
        assert sum(r[2] for r in want) > 1000
        assert run(frame, bucket_words=buckets) == want


def test_short_window(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    frame = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(4)
    assert run(frame, window=6, bucket_words=30) == brute(rows, 6)


def test_edge_cases(spark):
    line = " ".join(f"p{i}" for i in range(55))
    long = " ".join(f"q{i}" for i in range(200_000))
    rows = [(5, line), (5, line), (3, line + "\n" + line), (None, line), (None, None), (7, None), (8, " \t"), (9, "x\x1cy " * 30), (9, "x\x1cy " * 80), (10, long), (11, "z " + long), (2, line.replace(" ", "\x0b")), (12, line + " " + line)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert run(frame) == brute(rows)
    assert run(frame.limit(0)) == []


def test_one_passage_in_many_documents(spark):
    rng = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(70))
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(rng.randrange(5, 40))) + " " + hot + " end" + str(i)) for i in range(3000)]
    frame = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(6)
    got = run(frame)
    assert [r[2] for r in sorted(got)] == [0] + [70] * 2999


def test_lots_send_a_shared_hash_at_most_twice():
    import pyarrow as pa

    hot = " ".join(f"h{i}" for i in range(70))
    lot = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array([hot + f" e{i}" for i in range(500)])], ["doc_id", "text"])
    sent = sum(len(v) // 4 for b in substrings._probes(iter([lot]), 50, 3) for k, v in zip(b.column(0).to_pylist(), b.column(3).to_pylist()) if k >= 0)
    assert sent <= 2 * 46 + 500
