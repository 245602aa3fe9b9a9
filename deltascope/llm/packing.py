"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Encoder, bound_batches, materialize, trim, two_level_rank

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_document(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: only longer documents are cut; the first piece takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenize_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (array<int>). ``lean``: less memory, more time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = Encoder.get(vocabulary, lead=True, lean=lean), np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for d, own in zip(b["doc_id"], enc.encode_many(list(b["text"]))):
                ids = np.concatenate([own.astype("<u4"), end])
                for k, (s, n) in enumerate(cut_document(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((d, k, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            if lean:
                trim()
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES + ", ids array<int>" * with_ids)


def fill_patterns(hist: dict[int, int], capacity: int) -> list[list]:
    """Best-fit decreasing on the length histogram: [pieces, multiplicity] patterns, each step uses up one length."""
    left, out = Counter({k: v for k, v in hist.items() if v}), []
    lengths = sorted(left, reverse=True)
    while lengths:
        pieces, room, used = [], capacity, Counter()
        for length in lengths:
            if length > room:
                continue
            n = min(left[length], room // length)
            pieces += [length] * n
            used[length] += n
            room -= n * length
            if room == 0:
                break
        times = min(left[k] // v for k, v in used.items())
        out.append([pieces, times])
        for k, v in used.items():
            left[k] -= v * times
        lengths = [k for k in lengths if left[k]]
    return out


def _exchange(giver: Counter, taker: Counter, gap: int) -> tuple[int, list[int], list[int]] | None:
    """The exchange that fills the taker most: move one, swap one for one, or two for one. (gain, given, returned).
    Bins are counted by length: whatever they hold, they have at most about sqrt(2 * capacity) different lengths."""
    best, mine, theirs = None, sorted(giver, reverse=True), sorted(taker)
    for i, a in enumerate(mine):
        if a <= gap and (best is None or a > best[0]):
            best = (a, [a], [])
        for b in theirs:
            if 0 < a - b <= gap and (best is None or a - b > best[0]):
                best = (a - b, [a], [b])
        for c in mine[i:] if giver[a] > 1 else mine[i + 1 :]:
            for b in theirs:
                if 0 < a + c - b <= gap and (best is None or a + c - b > best[0]):
                    best = (a + c - b, [a, c], [b])
        if best is not None and best[0] == gap:
            break
    return best


def local_search(patterns: list[list], capacity: int) -> list[list]:
    """Exchange pieces between underfull bins, always towards the fuller one, so that the sum of squared fills grows with
    every exchange. Of these exchanges those are made that fill the taker or empty the giver, until no pair of bins has one
    left: each leaves no more kinds of underfull bins than there were, so the search ends soon whatever the histogram.
    Like bins exchange together; a pair is looked at again only after one of its bins has changed."""
    done, bins = [p for p in patterns if sum(p[0]) == capacity], Counter()
    for pieces, times in patterns:
        if sum(pieces) < capacity:
            bins[tuple(sorted(pieces, reverse=True))] += times
    fill, count = {x: sum(x) for x in bins}, {x: Counter(x) for x in bins}
    todo = sorted(bins, key=fill.get, reverse=True)
    while todo:
        one = todo.pop()
        for other in sorted(bins, key=fill.get, reverse=True):
            if one not in bins:
                break
            if other not in bins or (one == other and bins[one] < 2):
                continue
            giver, taker = (one, other) if fill[one] <= fill[other] else (other, one)
            found = _exchange(count[giver], count[taker], capacity - fill[taker])
            # ends a bin for good: the taker is full or the giver empty
            if not found or not (found[0] == capacity - fill[taker] or (not found[2] and len(found[1]) == len(giver))):
                continue
            times = bins[giver] // 2 if giver == taker else min(bins[giver], bins[taker])
            for old, out, into in ((giver, found[1], found[2]), (taker, found[2], found[1])):
                rest = list(old)
                for x in out:
                    rest.remove(x)
                new = tuple(sorted(rest + into, reverse=True))
                bins[old] -= times
                if bins[old] <= 0:
                    del bins[old]
                if sum(new) == capacity:
                    done.append([list(new), times])
                elif new:
                    if new not in bins:
                        fill[new], count[new] = sum(new), Counter(new)
                        todo.append(new)
                    bins[new] += times
            if one in bins:
                todo.append(one)
                break
    return done + [[list(k), v] for k, v in bins.items()]


def assign(pieces: DataFrame, capacity: int, bucket_rows: int = 1000) -> DataFrame:
    """Add sequence_id and offset to pieces. Only the length histogram (at most ``capacity`` rows) reaches the driver;
    ranks within a length come from a two-level prefix sum, so no length is gathered in one task. A piece looks its place
    up by length and rank in the sorted starts of the slots: one slot a piece of a pattern, at most ``capacity`` a pattern,
    whatever the number of documents."""
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    patterns = local_search(fill_patterns(hist, capacity), capacity)
    slots, base, seen = [], 0, Counter()
    for own, times in sorted(patterns, key=lambda p: (-sum(p[0]), p[0])):
        at = 0
        for length in own:
            slots.append((length, seen[length], base, at))
            seen[length] += times
            at += length
        base += times
    plan = np.array(sorted(slots), np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast((plan[:, 0] << 48 | plan[:, 1], plan))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, rows = shared.value
        r = rank.to_numpy(np.int64) - 1
        own = rows[np.searchsorted(starts, length.to_numpy(np.int64) << 48 | r, side="right") - 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + r - own[:, 1], "offset": own[:, 3]})

    ranked = two_level_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"], -(-max(hist.values(), default=1) // bucket_rows), "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, lean: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Null and empty texts hold the end id alone. Repeated rows are packed once each. Extra columns are ignored.
    An empty table gives an empty result. Texts of any length are cut, never truncated. ``lean``: for sessions whose
    workers have other work too.
    """
    bound_batches(docs.sparkSession, 4 << 20 if lean else 8 << 20)
    pieces = materialize(tokenize_pieces(docs, vocabulary, end_id, capacity, lean=lean))
    return assign(pieces, capacity)
