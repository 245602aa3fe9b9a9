"""Repeated passages: fixed blocks as anchors, probed by every rolling window, extended to whole repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .shingles import _mix, _powers_of, word_hashes

#: Packed entries of one batch for one bucket: documents (id differences), entries of each, values, gaps between places.
PACKED = "bucket int, docs binary, counts binary, values binary, low binary, high binary"
REMOVED = "doc_id long, row long, starts binary"
_FAR = np.iinfo(np.int64).max


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in a row."""
    power, inverse = _powers_of(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[: len(words)])])
    n = max(0, len(words) - k + 1)
    return _mix((sums[k:] - sums[:n]) * inverse[:n]) if n else words[:0]


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` values in a row."""
    span = 1
    while 2 * span <= k:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (k - span)], values[k - span :])


def _pack(bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, value: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """Rows of ``PACKED``; entries come in order of (doc, place), ``doc`` points into ``ids``."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place, value = bucket[order], doc[order], place[order], value[order] if len(value) else value
    cut = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        d, p = doc[a:b], place[a:b]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        gap = np.diff(p, prepend=0)
        gap[first] = p[first]
        yield (int(bucket[a]), np.diff(ids[d[first]], prepend=0).tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes(), value[a:b].tobytes(),
               (gap & 255).astype(np.uint8).tobytes(), (gap >> 8).astype("<u4" if (gap >> 16).any() else np.uint8).tobytes())


def _unpack(row, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, entries of each, places and values of one packed row."""
    docs, counts = np.cumsum(np.frombuffer(row.docs, np.int64)), np.frombuffer(row.counts, "<u4")
    gap = np.frombuffer(row.low, np.uint8).astype(np.int64)
    gap += np.frombuffer(row.high, np.uint8 if len(row.high) == len(row.low) else "<u4").astype(np.int64) << 8
    sums = np.cumsum(gap)
    begin = np.cumsum(counts) - counts
    before = np.where(begin > 0, sums[begin - 1], 0)
    return docs, counts, sums - np.repeat(before, counts), np.frombuffer(row.values, kind)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, where each group begins in that order, and the group of each entry in that order."""
    order = np.argsort(values, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0])) if len(values) else order
    group = np.zeros(len(values), np.int64)
    group[begin[1:]] = 1
    return order, begin, np.cumsum(group)


def _bypass(ids: np.ndarray, n: int) -> np.ndarray:
    """A bucket of the lot's own, below 0, for what needs no meeting with other lots."""
    own = _mix(np.array([ids[0] if len(ids) else 0, len(ids)], np.int64).view(np.uint64))
    return np.full(n, -1 - int((own[0] ^ own[1]) % np.uint64(1 << 30)))


def _thinned(doc: np.ndarray, place: np.ndarray, block: int) -> np.ndarray:
    """Of neighbouring anchors the first, every ``block``-th and the last: windows that hold any of them hold one of these."""
    fresh = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(place) != 1)])
    at = np.arange(len(doc))
    offset = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return at[(offset % block == 0) | np.append(fresh[1:], True)]


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _column(batches: list[pa.RecordBatch], name: str) -> list:
    return [x for b in batches for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def _probes(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Every rolling half window of every text with a whole window, packed by bucket of its hash; a place divisible by
    the block's length is a reference block. What several documents of one lot share is an anchor in all of them at
    once (bucket below 0); of those only the first block and the last window are sent, enough for the other lots."""
    block = window // 2
    for lot in _lots(batches, 8 << 20):
        ids = np.array(_column(lot, "doc_id"), np.int64)
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        texts = _column(lot, "text")
        own = [w if len(w) >= window else w[:0] for w in word_hashes([texts[i] for i in by_id.tolist()])]
        lengths = np.array([len(w) for w in own])
        words = np.concatenate(own) if own else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(own)), lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = _windows(words, block)
        whole = np.flatnonzero(place[: len(h)] + block <= lengths[doc[: len(h)]])
        h, doc, place = h[whole], doc[whole], place[whole]
        order, begin, group = _groups(h)
        owner = ids[doc[order]]
        least, most = (np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)) if len(begin) else (owner, owner)
        shared = (least < most)[group]
        keep = np.ones(len(h), bool)
        if shared.any():
            at = order[shared]  # by value, then (doc, place)
            keep[at] = False
            g = group[shared]
            last = np.flatnonzero(np.append(np.diff(g) != 0, True))
            keep[at[last]] = True
            blocks = np.flatnonzero(place[at] % block == 0)
            first = blocks[np.concatenate([[True], np.diff(g[blocks]) != 0])] if len(blocks) else blocks
            keep[at[first]] = True
            direct = np.sort(at)
            direct = direct[_thinned(doc[direct], place[direct], block)]
            yield from _table(_pack(_bypass(ids, len(direct)), doc[direct], place[direct], np.zeros(0, "<u4"), ids))
        sent = np.flatnonzero(keep)
        yield from _table(_pack((h[sent] % np.uint64(buckets)).astype(np.int64), doc[sent], place[sent], (h[sent] >> np.uint64(32)).astype("<u4"), ids))


def _table(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    cols = list(zip(*rows))
    if cols:
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [f.split()[0] for f in PACKED.split(", ")])


def _anchors(frame, block: int):
    """Places of one bucket where a reference block meets a rolling window of a document with a larger id: such windows,
    and the blocks that they meet."""
    import pandas as pd

    packed = [_unpack(r, "<u4") for r in frame.itertuples(index=False)]
    if frame["bucket"].iloc[0] < 0:
        return pd.DataFrame({"doc_id": np.concatenate([np.repeat(d, c) for d, c, *_ in packed]), "at": np.concatenate([p for *_, p, _ in packed]).astype(np.int32)})
    doc = np.concatenate([np.repeat(d, c) for d, c, *_ in packed])
    place, h = (np.concatenate([p[k] for p in packed]) for k in (2, 3))
    order, begin, group = _groups(h)
    doc, place = doc[order], place[order]
    is_block = place % block == 0
    first = np.minimum.reduceat(np.where(is_block, doc, _FAR), begin)[group]
    last = np.maximum.reduceat(doc, begin)[group]
    hit = (doc > first) | (is_block & (doc < last))
    return pd.DataFrame({"doc_id": doc[hit], "at": place[hit].astype(np.int32)})


def _extended(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The whole windows around the anchors of each text with their 64-bit keys. A window's bucket is that of the least
    hash among its short word runs, which neighbouring windows mostly share. Of a key that several documents of one lot
    hold, those of the smallest id alone are sent; the others are known to repeat it (bucket below 0)."""
    block, short = window // 2, max(1, window // 6)
    for lot in _lots(batches, 8 << 20):
        ids = np.array(_column(lot, "doc_id"), np.int64)
        by_id = np.argsort(ids, kind="stable")
        ids, rows = ids[by_id], np.array(_column(lot, "row"), np.int64)[by_id]
        texts, anchors = _column(lot, "text"), _column(lot, "anchors")
        doc, place, key, least = [], [], [], []
        for d, i in enumerate(by_id.tolist()):
            (words,) = word_hashes([texts[i]])
            n = len(words) - window + 1
            if n <= 0:
                continue
            at = np.asarray(anchors[i], np.int64)
            edge = np.zeros(len(words) + 2, np.int64)  # an anchor at a is held by the windows that start in [a - block, a]
            at = at[at < len(words)]
            np.add.at(edge, np.maximum(at - block, 0), 1)
            np.add.at(edge, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            h = _windows(words, block)
            doc.append(np.full(len(starts), d))
            place.append(starts)
            least.append(_least(_windows(words, short), window - short + 1)[starts])
            key.append(_mix(_mix(h[starts] + np.uint64(0x9E3779B97F4A7C15)) ^ (h[starts + block] * np.uint64(0xC2B2AE3D27D4EB4F))))
        if not doc:
            continue
        doc, place, key, least = map(np.concatenate, (doc, place, key, least))
        order, begin, group = _groups(key)
        if not len(order):
            continue
        owner = ids[doc[order]]
        later = np.zeros(len(key), bool)
        later[order] = owner > np.minimum.reduceat(owner, begin)[group]
        both = np.stack([ids, rows], 1)
        lot_rows = np.arange(len(ids))
        known, open_ = np.flatnonzero(later), np.flatnonzero(~later)
        yield from _table(_two(_pack(_bypass(ids, len(known)), doc[known], place[known], key[:0], lot_rows), both))
        bucket = (_mix(least[open_]) % np.uint64(buckets)).astype(np.int64)
        yield from _table(_two(_pack(bucket, doc[open_], place[open_], key[open_], lot_rows), both))


def _two(packed: Iterator[tuple], both: np.ndarray) -> Iterator[tuple]:
    """Put all doc_ids (as differences), then all rows, in the place of the texts' numbers in their lot."""
    for bucket, docs, *rest in packed:
        own = both[np.cumsum(np.frombuffer(docs, np.int64))]
        yield (bucket, np.concatenate([np.diff(own[:, 0], prepend=0), own[:, 1]]).tobytes(), *rest)


def _repeats(frame):
    """Of one bucket's windows, those of which a document with a smaller id holds the same words: a row a document."""
    import pandas as pd

    docs, rows, counts, place, key = [], [], [], [], []
    for r in frame.itertuples(index=False):
        both = np.frombuffer(r.docs, np.int64)
        half = len(both) // 2
        _, c, p, k = _unpack(r._replace(docs=both[:half].tobytes()), "<u8")
        docs.append(np.cumsum(both[:half]))
        rows.append(both[half:])
        counts.append(c)
        place.append(p)
        key.append(k)
    docs, rows, counts, place, key = map(np.concatenate, (docs, rows, counts, place, key))
    cell = np.repeat(np.arange(len(docs)), counts)
    if frame["bucket"].iloc[0] >= 0:
        order, begin, group = _groups(key)
        owner = docs[cell[order]]
        found = order[owner > np.minimum.reduceat(owner, begin)[group]]
        found.sort()
        cell, place = cell[found], place[found]
    cut = np.concatenate([np.flatnonzero(np.diff(cell, prepend=-1)), [len(cell)]])
    own = cell[cut[:-1]]
    step = np.diff(place, prepend=0)  # differences of places, which a shuffle packs well
    step[cut[:-1]] = place[cut[:-1]]
    step = step.astype("<u4")
    return pd.DataFrame({"doc_id": docs[own], "row": rows[own], "starts": [step[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]})


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Words without those that a repeated window covers."""
    for b in batches:
        texts, rows, starts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "row", "starts"))
        n_words, n_removed, kept, spans = [], [], [], []
        for text, row, several in zip(texts, rows, starts):
            own = [s["starts"] for s in several or [] if s["row"] == row]
            words = text.split() if text else []  # bytes split at exactly the six signs of the contract
            found: list[dict[str, int]] = []
            gone = 0
            if own:
                at = np.concatenate([np.cumsum(np.frombuffer(s, "<u4").astype(np.int64)) for s in own])
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                gone = len(words) - int(stays.sum())
                turn = np.flatnonzero(np.diff(stays.astype(np.int8), prepend=1, append=1))
                found = [{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2])]
                words = [w for w, s in zip(words, stays.tolist()) if s]
            n_words.append(len(words) + gone)
            n_removed.append(gone)
            kept.append(b" ".join(words))
            spans.append(found)
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept", "repeats"])


def remove_repeats(docs: DataFrame, window: int = 50, bucket_words: int = 500_000) -> DataFrame:
    """Remove every word covered by a window of ``window`` (even) consecutive words that a document with a smaller doc_id
    holds as well; windows are judged on the input. Returns doc_id, n_words, n_removed, kept (the words left, joined by
    one space) and repeats (start and length, in words, of the maximal stretches removed).

    Every text is cut into blocks of half a window, so that each window holds one whole block. All rolling half windows
    probe the blocks, hash by hash; where a block of a smaller document is met, both sides have an anchor. Around the
    anchors only, the whole windows are compared by 64-bit keys (a key joins two 64-bit hashes of half a window and is
    told apart within its bucket; two different windows are taken for one with a chance of about 1 in 2^64 a pair), so
    neighbouring windows make maximal repeats. Both comparisons are aggregates (smallest id with a block, largest with a
    window; smallest id of a key): no pairs are made, and what many documents of one lot share is decided there and sent
    once or twice a lot. The texts are shuffled once, by doc_id.

    A null doc_id is neither smaller nor larger than another: such rows lose nothing and take nothing. Rows of one
    doc_id do not remove one another; repeated rows stay. A null text has no words. Other columns go; no rows give none.
    """
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    spark = docs.sparkSession
    bound_batches(spark)
    # a column that has its type already stays as it is: both readers of the texts then share one shuffle
    rows = docs.select(*[c if docs.schema[c].dataType.simpleString() == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))])
    named = rows.where(F.col("doc_id").isNotNull())
    length = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + length // (6 * bucket_words)
    block = window // 2
    probes = named.mapInArrow(lambda b: _probes(b, window, buckets), PACKED)
    hits = probes.groupBy("bucket").applyInPandas(lambda f: _anchors(f, block), "doc_id long, at int").groupBy("doc_id").agg(F.collect_list("at").alias("anchors"))
    held = named.withColumn("row", F.xxhash64("text"))
    anchored = held.join(hits, "doc_id").select("doc_id", "row", "text", "anchors")
    keys = anchored.mapInArrow(lambda b: _extended(b, window, 1 + buckets // 3), PACKED)
    removed = keys.groupBy("bucket").applyInPandas(_repeats, REMOVED).groupBy("doc_id").agg(F.collect_list(F.struct("row", "starts")).alias("starts"))
    judged = held.join(removed, "doc_id", "left").select("doc_id", "row", "text", "starts")
    rest = rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("row"), "text", F.lit(None).cast("array<struct<row: long, starts: binary>>").alias("starts"))
    out = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: long, length: long>>"
    return judged.union(rest).withColumn("text", F.col("text").cast("binary")).mapInArrow(lambda b: _cut(b, window), out)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
m AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT rid, i FROM g JOIN m USING (s) WHERE doc_id > first),
c AS MATERIALIZED (SELECT DISTINCT rid, i + k AS i FROM r, range(50) t(k)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN c USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""
