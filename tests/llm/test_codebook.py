"""Vector codes against brute force."""

import hashlib
import random

import numpy as np

from deltascope.llm import codebook


def test_nearest_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        size, w = int(rng.integers(1, 300)), int(rng.integers(1, 9))
        spread = int(rng.choice([2, 30, 2000, 1 << 40]))
        entries = rng.integers(-spread, spread + 1, (size, w))
        x = rng.integers(-spread, spread + 1, (200, w))
        x[:20] = entries[rng.integers(0, size, 20)]
        index, best = codebook.Entries(entries.tolist()).nearest(x if spread < 1 << 25 else x.astype(object))
        far = ((x.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(2)
        want = [min((d, e) for e, d in enumerate(row)) for row in far.tolist()]
        assert [(int(b), int(i)) for b, i in zip(best, index)] == want


def test_pruning_skips_entries():
    rng = np.random.default_rng(4)
    entries = rng.normal(size=(256, 16)) * np.linspace(1, 400, 256)[:, None]
    book = codebook.Entries(np.floor(entries).astype(int).tolist())
    seen = 0

    class Seen(np.ndarray):
        def __getitem__(self, at):
            nonlocal seen
            seen += np.size(at)
            return np.asarray(self)[at]

    book.sorted = book.sorted.view(Seen)
    x = np.floor(entries + rng.normal(size=entries.shape)).astype(np.int64)
    book.nearest(x)
    assert seen < 256 * 256 / 10


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [int(np.floor(1024 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    n = len(kept[0][2])
    cut = lambda v, p: v[p * n // parts : (p + 1) * n // parts]
    first = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    assign = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for *_, v in kept:
                own.setdefault(assign(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else y for e, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    out = []
    for i, label, v in kept:
        best = [assign(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label, sha))
    totals = {}
    for _, _, d, label, _ in out:
        totals[label] = totals.get(label, 0) + d
    return sorted(((i, c, d, totals[label], sha) for i, c, d, label, sha in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def test_compress_against_plain(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for i in range(400)]
    rows += [rows[3], rows[3], (5, rows[4][1], 1), (900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, None)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, codebook.compress(frame).collect()), key=str) == plain(rows)


def test_edge_cases(spark):
    few = [(7, [1.5, -2.5, 0.0, 3.0], None), (3, [1.0, 1.0, 1.0, 1.0], 2), (3, [1.0, 1.0, 1.0, 1.0], 2)]
    frame = spark.createDataFrame([(*r, "", 0) for r in few], SCHEMA)
    assert sorted(map(tuple, codebook.compress(frame).collect()), key=str) == plain(few)
    assert codebook.compress(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0] * 4, 1, "", 0), (1, [2.0] * 8, 1, "", 0), (2, [3.0] * 5, 1, "", 0), (3, [], 1, "", 0), (4, [3e38, -3e38, 1.0, 2.0], 1, "", 0)], SCHEMA)
    got = {r["vec_id"]: r for r in codebook.compress(odd).collect()}
    assert set(got) == {None, 1, 3, 4} and got[3]["error"] == 0 and got[3]["code"] == "00" * 4
    assert got[1]["codebooks_sha256"] != got[4]["codebooks_sha256"]
    assert codebook.compress(frame.drop("label")).count() == 3
