"""Periodic runs of words in linear time: Lyndon arrays on an ordered alphabet, extensions matched once and reused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For every position i the next smaller suffix (end of the longest Lyndon word from i) and how far both suffixes agree.

    Suffixes are compared by symbols alone. Each position r meets the previous smaller suffixes from r - 1 down until one
    stays below it; what two neighbours of that chain have in common is known, so a comparison starts where the last one
    ended. Of all matches the one that reaches furthest is kept: inside of it a pair's extension is read off its copy
    further left, and only beyond its end are symbols compared. That end never moves back, hence linear time.
    """
    n = len(t)
    nss, agree = [n] * n, [0] * n
    pss, below = [-1] * n, [0] * n  # previous smaller suffix, and how far it agrees
    since = shift = end = 0  # the furthest match: t[since:end] equals t[since - shift:end - shift]
    for r in range(1, n):
        i, common, known = r - 1, 0, 0
        while True:
            if common < known:  # both agree longer with each other than the last one with r
                size = common
            elif common > known:
                size = known
            else:
                size = common
                fresh = True
                if i >= since and since < r < end:
                    a, b = i - shift, r - shift
                    size = agree[a] if nss[a] == b else below[b] if pss[b] == a else 0
                    if r + size < end:
                        fresh = False
                    else:
                        size = end - r
                if fresh:
                    a, b = i + size, r + size
                    while b < n and t[a] == t[b]:
                        a += 1
                        b += 1
                    size = b - r
            if size and r + size >= end:
                since, shift, end = r, r - i, r + size
            if r + size < n and t[i + size] < t[r + size]:
                pss[r], below[r] = i, size
                break
            nss[i], agree[i] = r, size
            common, known, i = size, below[i], pss[i]
            if i < 0:
                break
    return nss, agree


def runs(t: list[int], least_exponent: int = 2, least_length: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of ``t`` with at least ``least_exponent`` (two or more) periods and
    ``least_length`` symbols, by start, then period. A run's roots are longest Lyndon words in one of the two orders of
    the alphabet. Only its first root looks to the left, over less than a period."""
    found = set()
    for order in (t, [-x for x in t]):
        nss, agree = lyndon(order)
        n = len(t)
        for i, size in enumerate(agree):
            j = nss[i]
            p = j - i
            if size <= (least_exponent - 2) * p:
                continue
            k = i - p
            if k >= 0 and nss[k] == i and agree[k] == size + p:
                continue  # not its first root
            a = i - 1
            while a >= 0 and t[a] == t[a + p]:
                a -= 1
            length = j + size - a - 1
            if j < n and length >= least_exponent * p and length >= least_length:
                found.add((a + 1, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(ids: np.ndarray, cut: np.ndarray, least_exponent: int, least_length: int, rounds: int = 4) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``ids`` that can hold a run: a run of e periods has each of its symbols e times, so
    symbols rarer than that within their stretch end it, round by round. No run crosses such a symbol or ends at one
    that would continue it. ``cut`` holds the texts' borders."""
    where = np.arange(len(ids))
    part = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    for _ in range(rounds):
        if not len(where):
            break
        key = part.astype(np.int64) * (int(ids.max()) + 1) + ids[where]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = counts[inverse] >= least_exponent
        if often.all():
            break
        where, part = where[often], part[often]
        begins = np.ones(len(where), bool)
        begins[1:] = (np.diff(where) > 1) | (np.diff(part) > 0)
        part = np.cumsum(begins) - 1
        long = np.bincount(part, minlength=1)[part] >= least_length if len(part) else begins
        where, part = where[long], part[long]
    if not len(where):
        return []
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (np.diff(part) > 0)]))
    ends = np.append(begins[1:], len(where)) - 1
    return [(int(a), int(b) + 1) for a, b in zip(where[begins], where[ends]) if b + 1 - a >= least_length]


def _find(texts: list[bytes | None], least_exponent: int, least_length: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    words = [t.split() if t else [] for t in texts]  # bytes split at exactly the six signs of the contract
    rank: dict[bytes, int] = {}
    for w in words:
        for x in w:
            rank.setdefault(x, 0)
    for k, x in enumerate(sorted(rank)):
        rank[x] = k + 1
    ids = np.fromiter((rank[x] for w in words for x in w), np.int64, sum(map(len, words)))
    cut = np.cumsum([0, *map(len, words)])
    spans = stretches(ids, cut, least_exponent, least_length)
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in spans:
        k = int(np.searchsorted(cut, a, "right")) - 1
        own[k] += [(s + a - int(cut[k]), length, p) for s, length, p in runs(ids[a:b].tolist(), least_exponent, least_length)]
    for w, found in zip(words, own):
        if found:
            gone = np.zeros(len(w) + 1, np.int64)
            for s, length, p in found:
                gone[s + p] += 1
                gone[s + length] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            yield len(w), found, b" ".join([x for x, g in zip(w, gone.tolist()) if not g])
        else:
            yield len(w), found, b" ".join(w)


def find_runs(docs: DataFrame, least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """Every run of words in ``text`` with at least ``least_exponent`` whole periods and ``least_length`` words.

    Returns doc_id, n_words, runs (start and length in words from 0, smallest period; by start, then period) and collapsed:
    the words joined by one space, without those that some run holds after its first period. Row by row: a null or
    wordless text has no run and an empty collapsed text; a null doc_id stays, repeated rows stay, other columns go. No
    shuffle; a task holds a batch of about 4 MB of texts, or one text that is larger.
    """
    bound_batches(docs.sparkSession)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(_find(b.column(1).to_pylist(), least_exponent, least_length))
            flat = np.array([x for _, found, _ in out for x in found], np.int64).reshape(-1, 3)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            ends = pa.array(np.cumsum([0, *(len(found) for _, found, _ in out)]), pa.int32())
            texts = pa.array([text for *_, text in out], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, *_ in out], pa.int64()), pa.ListArray.from_arrays(ends, cells), texts],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(per_batch, RUNS)


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts of the query: where h = crc32(doc_id) ends in 0, the words from a = g % n on repeat the first
    p = 1 + (n - a) div (3 + g % 8) of them, g = h div 10. Other texts, and those without words, stay as they are."""
    h = F.expr("crc32(cast(cast(doc_id as string) as binary))")
    words = F.filter(F.split(F.col("text"), SPACE), lambda x: x != "")
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    g = F.floor(F.col("_h") / 10)
    n = F.size("_w")
    measured = chosen.withColumn("_g", g).withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.expr("cast(_g % _n as int)")))
    measured = measured.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    made: Column = F.expr("array_join(concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, _n - _a)), ' ')")
    return measured.select("doc_id", F.when(F.coalesce((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.lit(False)), made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one (ties: smallest start, then period) and two digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("_best.start")), F.col("_best.length"), (-F.col("_best.period"))
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
