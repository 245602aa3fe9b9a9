"""Exact n-gram Jaccard join of whole texts by set relations: index lists are skipped in blocks by size and position,
and what one set's comparisons have shown answers for the sets close to it.

1. Equal texts fall together (a hash aggregation).
2. Every set keeps a hash-ordered prefix P long enough to hold at least l common shingles of any linked pair; document
   frequencies are counted on P alone, in packed rows dealt by hash range.
3. P is put in order of frequency and indexed by its own prefix: shingles of one document never enter a list.
4. In each list every set meets the list's pivot. Linked sets form components; their pairs need no further look.
5. Pairs that remain across components are skipped in blocks by size, by position, by the triangle inequality on
   distances to a common pivot, and by parity bitmaps that bound the symmetric difference.
6. The answers of the rest are derived: a set takes the overlap that its highly similar pivot is known to have with the
   other set and corrects it by the difference of the two; only pairs without such a pivot are compared from nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, maybe_broadcast, trim
from .components import connected_components
from .shingles import shingle_sets

BLOCK = 64


def _bitmap(own: np.ndarray) -> bytes:
    """Parity of the hashes' low bits; its width is a power of two, at least twice the set, and folds by xor."""
    width = max(256, 1 << int(2 * len(own) - 1).bit_length())
    ones = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(bool)).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    # the lowest index bits choose the place in the narrower bitmap, so halves of the wider one fall together
    return bits if bits.size == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


class Join:
    def __init__(self, words: int = 4, num: int = 85, slack: int = 15, list_rows: int = 20_000, bucket_tokens: int = 200_000):
        """Link when 100 * intersection >= ``num`` * union. ``slack``: percent of a set's size that P holds beyond the
        plain prefix; ``list_rows``: longer lists are compared in pairs of blocks, none is cut short."""
        self.words, self.num, self.slack, self.list_rows, self.bucket_tokens = words, num, min(slack, num), list_rows, bucket_tokens

    # -- sizes, the same in Python and SQL -----------------------------------------------------------------------
    def part(self, n):
        """Size of P."""
        m = n - (self.num * n + 99) // 100 + (self.slack * n + 99) // 100
        return np.minimum(n, m)

    def common(self, n):
        """Common shingles that P holds for any pair whose smaller set has ``n``."""
        return (self.slack * n + 99) // 100

    def _sql_part(self) -> str:
        return f"least(n, n - ({self.num} * n + 99) div 100 + ({self.slack} * n + 99) div 100)"

    def _sql_common(self) -> str:
        return f"({self.slack} * (({self.num} * n + 99) div 100) + 99) div 100"

    # -- steps ---------------------------------------------------------------------------------------------------
    def prefixes(self, texts: DataFrame, buckets: int) -> DataFrame:
        """Rows (doc, n, tok, df): one with tok null for each document, one for each shingle of P that two or more hold.

        Counted in two levels: each lot of documents counts its own shingles, a bucket (a range of hashes) adds those
        counts, and the lots look the sums up. Within a bucket 32 bits of a hash stand for it: shingles that share them share
        a sum, alike in all documents, which orders them no worse and loses none. A bucket that a common shingle makes large is looked up in slices of about
        ``bucket_tokens`` entries, so that a shingle held by all documents is never gathered in one task."""
        words, part, bucket_tokens = self.words, self.part, self.bucket_tokens

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, docs, sizes, total = [], [], [], 0

            def flush() -> pd.DataFrame:
                toks, at = np.concatenate(held), np.repeat(np.arange(len(docs), dtype=np.uint32), [len(x) for x in held])
                ids, ns = np.array(docs, np.int64), np.array(sizes, np.int32)
                where = (toks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(toks, kind="stable")  # by hash, and so by bucket
                toks, at, where = toks[order], at[order], where[order]
                cut = np.flatnonzero(np.diff(where, prepend=np.uint64(2**63), append=np.uint64(2**63)))
                lot = int(ids[0])
                rows = [("docs", 0, lot, b"", b"", ids.tobytes(), ns.tobytes())]
                for a, b in zip(cut[:-1], cut[1:]):
                    own, local = np.unique(at[a:b], return_inverse=True)
                    keys, times = np.unique(toks[a:b].astype(np.uint32), return_counts=True)
                    often = times > 1
                    rows.append(("entries", int(where[a]), lot, toks[a:b].tobytes(), local.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), ids[own].tobytes(), ns[own].tobytes()))
                    rows.append(("counts", int(where[a]), lot, keys[~often].tobytes(), keys[often].tobytes(), b"", times[often].astype(np.uint32).tobytes()))
                return pd.DataFrame(rows, columns=["kind", "bucket", "lot", "toks", "at", "docs", "ns"])

            for b in batches:
                for d, own in zip(b["doc"], shingle_sets(list(b["text"]), words)):
                    held.append(own[: part(len(own))])
                    docs.append(d)
                    sizes.append(len(own))
                    total += len(held[-1])
                    if total > 250_000:
                        yield flush()
                        held, docs, sizes, total = [], [], [], 0
            if docs:
                yield flush()
            trim()

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            once, often, times = (np.concatenate([np.frombuffer(x, np.uint32) for x in frame[c]]) for c in ("toks", "at", "ns"))
            keys, n = np.concatenate([once, often]), np.concatenate([np.ones(len(once), np.int64), times.astype(np.int64)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            df = np.add.reduceat(n[order], first)
            keep = df > 1
            trim()
            return pd.DataFrame({"bucket": frame["bucket"][:1], "slices": [max(1, -(-int(n.sum()) // bucket_tokens))], "common": [keys[first][keep].tobytes()], "df": [df[keep].tobytes()]})

        def look_up(entries: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            common, df = np.frombuffer(sums["common"].iloc[0], np.uint32), np.frombuffer(sums["df"].iloc[0], np.int64)
            out = []
            for toks, at, docs, ns in zip(entries["toks"], entries["at"], entries["docs"], entries["ns"]):
                toks = np.frombuffer(toks, np.uint64)
                at = np.frombuffer(at, np.uint16 if len(at) == 2 * len(toks) else np.uint32)
                if not len(common):
                    continue
                keys = toks.astype(np.uint32)
                place = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                hit = common[place] == keys
                out.append((np.frombuffer(docs, np.int64)[at[hit]], np.frombuffer(ns, np.int32)[at[hit]].astype(np.int64), toks[hit].view(np.int64), df[place[hit]]))
            trim()
            return pd.DataFrame({k: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i, k in enumerate(("doc", "n", "tok", "df"))})

        def sizes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for docs, ns in zip(b["docs"], b["ns"]):
                    yield pd.DataFrame({"doc": np.frombuffer(docs, np.int64), "n": np.frombuffer(ns, np.int32).astype(np.int64)})

        packed = materialize(texts.mapInPandas(pack, "kind string, bucket long, lot long, toks binary, at binary, docs binary, ns binary"))
        sums = materialize(packed.where("kind = 'counts'").select("bucket", "toks", "at", "ns").groupBy("bucket").applyInPandas(add, "bucket long, slices int, common binary, df binary"))
        slices = maybe_broadcast(sums.select(F.col("bucket").alias("_b"), "slices"), buckets)
        entries = packed.where("kind = 'entries'").join(slices, F.col("bucket") == F.col("_b")).withColumn("slice", F.pmod(F.xxhash64("lot"), F.col("slices")).cast("int")).select("bucket", "slice", "toks", "at", "docs", "ns")
        spread = sums.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "common", "df")
        found = entries.groupBy("bucket", "slice").cogroup(spread.groupBy("bucket", "slice")).applyInPandas(look_up, "doc long, n long, tok long, df long")
        alone = packed.where("kind = 'docs'").select("docs", "ns").mapInPandas(sizes_of, "doc long, n long")
        return found.unionByName(alone.select("doc", "n", F.lit(None).cast("long").alias("tok"), F.lit(0).cast("long").alias("df")))

    def entries(self, rows: DataFrame) -> DataFrame:
        """The index: (tok, doc, n, pos), without shingles that only one document would list."""
        own = rows.where("tok is not null").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("shared"))
        part, common = self._sql_part(), self._sql_common()
        own = own.withColumn("alone", F.expr(f"{part} - size(shared)")).withColumn("keep", F.expr(f"cast({part} - ({common}) + 1 - ({part} - size(shared)) as int)")).where("keep > 0")
        out = own.select("doc", "n", "alone", F.posexplode(F.slice("shared", 1, F.col("keep")))).select(F.col("col.tok").alias("tok"), "doc", "n", (F.col("alone") + F.col("pos")).alias("pos"))
        return materialize(out)

    def sets(self, texts: DataFrame) -> DataFrame:
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = shingle_sets(list(b["text"]), words)
                yield pd.DataFrame({"doc": b["doc"], "own": [x.tobytes() for x in own], "bits": [_bitmap(x) for x in own]})
                trim()

        return materialize(texts.mapInPandas(run, "doc long, own binary, bits binary"))

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, both, total, n, minus, plus) of each pair, counted exactly: sizes of intersection and union, the size of
        b's set and, for linked pairs, the elements that b's set lacks of a's and has beyond it."""
        num = self.num

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                rows = []
                for x, y in zip(f["x"], f["y"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    hit = y[at] == x
                    both = int(hit.sum())
                    total = len(x) + len(y) - both
                    linked = 100 * both >= num * total
                    rows.append((both, total, len(y), x[~hit].tobytes() if linked else None, np.delete(y, at[hit]).tobytes() if linked else None))
                out = pd.DataFrame(rows, columns=["both", "total", "n", "minus", "plus"])
                out.insert(0, "a", f["a"].to_numpy())
                out.insert(1, "b", f["b"].to_numpy())
                trim()
                yield out

        left = sets.select(F.col("doc").alias("a"), F.col("own").alias("x"))
        right = sets.select(F.col("doc").alias("b"), F.col("own").alias("y"))
        return materialize(pairs.join(right, "b").join(left, "a").mapInPandas(run, "a long, b long, both long, total long, n long, minus binary, plus binary"))

    def derive(self, pairs: DataFrame, sets: DataFrame, known: DataFrame, close: DataFrame) -> DataFrame:
        """(a, b, both, total) of each pair. A set x that is highly similar to a set p (``close``: doc, pivot, n, minus, plus)
        takes p's answer for y, if there is one (``known``: a, b, both), and corrects it by the difference of the two:
        the elements of p alone that y holds go, those of x alone come. Other pairs are counted from their sets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                both, total = [], []
                for base, n, minus, plus, y in zip(f["base"], f["n"], f["minus"], f["plus"], f["y"]):
                    y = np.frombuffer(y, np.uint64)
                    for sign, own in ((-1, minus), (1, plus)):
                        own = np.frombuffer(own, np.uint64)
                        if len(own):
                            base += sign * int((y[np.minimum(np.searchsorted(y, own), len(y) - 1)] == own).sum())
                    both.append(base)
                    total.append(n + len(y) - base)
                yield pd.DataFrame({"a": f["a"], "b": f["b"], "both": both, "total": total})

        pairs = materialize(pairs)
        sides = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("other")).unionByName(pairs.select("a", "b", F.col("b").alias("x"), F.col("a").alias("other")))
        own = sides.join(close.select(F.col("doc").alias("x"), "pivot", "n", "minus", "plus"), "x")
        answers = known.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("both").alias("base"))
        own = own.join(answers, (F.least("pivot", "other") == F.col("low")) & (F.greatest("pivot", "other") == F.col("high"))).dropDuplicates(["a", "b"])
        derived = materialize(own.join(sets.select(F.col("doc").alias("other"), F.col("own").alias("y")), "other").select("a", "b", "base", "n", "minus", "plus", "y").mapInPandas(run, "a long, b long, both long, total long"))
        direct = self.verify(pairs.join(derived.select("a", "b"), ["a", "b"], "left_anti"), sets).select("a", "b", "both", "total")
        return derived.unionByName(direct)

    def remaining(self, lists: DataFrame, every: bool) -> DataFrame:
        """Pairs across components that a list can't skip: all, or the closest of each two components."""
        num, slack = self.num, self.slack

        def pairs_of(docs, n, pos, comp, pivot, dist, bits) -> list[tuple]:
            order = np.argsort(n, kind="stable")
            bits = [np.frombuffer(x, np.uint64) for x in bits]
            docs, n, pos, comp, pivot, dist = (x[order] for x in (docs, n, pos, comp, pivot, dist))
            rest = self.part(n) - pos  # shingles of P from here on
            out, best = [], {}
            cuts = list(range(0, len(n), BLOCK)) + [len(n)]
            for p in range(len(cuts) - 1):
                a, b = cuts[p], cuts[p + 1]
                for q in range(p, len(cuts) - 1):
                    c, d = cuts[q], cuts[q + 1]
                    if 100 * n[b - 1] < num * n[c]:
                        break  # every later block is too large
                    if min(rest[a:b].max(), rest[c:d].max()) < (slack * n[a] + 99) // 100:
                        continue  # too late a position in all of the block
                    low = comp[a:b].min()
                    if low == comp[a:b].max() == comp[c:d].min() == comp[c:d].max():
                        continue
                    small, large = n[a:b, None], n[None, c:d]
                    ok = (100 * small >= num * large) & (np.minimum(rest[a:b, None], rest[None, c:d]) >= (slack * small + 99) // 100) & (comp[a:b, None] != comp[None, c:d])
                    far = np.abs(dist[a:b, None] - dist[None, c:d]) > (100 - num) / 100 + 1e-9
                    ok &= ~((pivot[a:b, None] == pivot[None, c:d]) & far)  # without a pivot the distance is no number, and nothing is far
                    if p == q:
                        ok &= np.tri(b - a, k=-1, dtype=bool).T
                    if not ok.any():
                        continue
                    width = min(bits[order[a]].size, bits[order[c]].size, *(bits[order[x]].size for x in (b - 1, d - 1)))
                    x, y = (np.stack([_fold(bits[order[i]], width) for i in range(*ends)]) for ends in ((a, b), (c, d)))
                    apart = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                    # with d elements apart, union = (n + m + d) / 2 and links have 100 d <= (100 - num) union
                    ok &= 200 * apart <= (100 - num) * (small + large + apart)
                    i, j = np.nonzero(ok)
                    first, second = docs[a + i], docs[c + j]
                    pairs = list(zip(np.minimum(first, second).tolist(), np.maximum(first, second).tolist()))
                    if every:
                        out += pairs
                        continue
                    one, two = comp[a + i], comp[c + j]
                    for pair, low, high, far_apart in zip(pairs, np.minimum(one, two).tolist(), np.maximum(one, two).tolist(), apart[i, j].tolist()):
                        if (low, high) not in best or far_apart < best[low, high][0]:
                            best[low, high] = (far_apart, pair)
            return out + [x[1] for x in best.values()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept, seen = None, set()
            for f in batches:
                f = f if kept is None else pd.concat([kept, f], ignore_index=True)
                last = (f["key"] != f["key"].iloc[-1]).to_numpy()
                kept, f = f[~last].reset_index(drop=True), f[last]
                yield from groups(f, seen)
            if kept is not None:
                yield from groups(kept, seen)

        def groups(f: pd.DataFrame, seen: set) -> Iterator[pd.DataFrame]:
            if not len(f):
                return
            keys = f["key"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            cols = [f[c].to_numpy() for c in ("doc", "n", "pos", "comp", "pivot", "dist", "bits")]
            found = []
            for a, b in zip(cut[:-1], cut[1:]):
                found += [x for x in pairs_of(*(c[a:b] for c in cols)) if x not in seen]
                seen.update(found[-10_000:])
                if len(seen) > 50_000:
                    seen.clear()
            trim()
            yield pd.DataFrame(list(set(found)), columns=["a", "b"], dtype=np.int64)

        return lists.mapInPandas(run, "a long, b long").distinct()

    def run(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

        Null, empty and wordless texts have no shingles and stand alone. Rows without doc_id stand alone with a null
        component. Rows that repeat a doc_id are one vertex. Extra columns are ignored; no rows give no rows.
        """
        bound_batches(docs.sparkSession)
        base = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
        keyed = materialize(base.select("doc", F.length("text").alias("len"), F.unhex(F.md5("text")).alias("key")))
        groups = keyed.where("key is not null and doc is not null").groupBy("key").agg(F.min("doc").alias("rep"))
        copies = materialize(keyed.join(groups, "key").where("doc <> rep").select("doc", "rep").distinct())
        chars, rows = keyed.agg(F.sum("len"), F.count("*")).first()
        n_copies = copies.count()
        texts = base.where("doc is not null and text is not null").join(maybe_broadcast(copies.select("doc").distinct(), n_copies), "doc", "left_anti")
        buckets = int(max(48, (chars or 0) / 6 * (100 - self.num + self.slack) / 100 / self.bucket_tokens))
        prefix = materialize(self.prefixes(texts, buckets))
        sizes = prefix.where("tok is null").groupBy("doc").agg(F.max("n").alias("n"))
        comps = self.link(texts, self.entries(prefix))
        rep = keyed.where("doc is not null").join(copies.groupBy("doc").agg(F.min("rep").alias("rep")), "doc", "left").select("doc", "key", F.coalesce("rep", "doc").alias("rep"))
        out = (rep.join(sizes.select(F.col("doc").alias("rep"), "n"), "rep", "left").join(comps.select(F.col("v").alias("rep"), "component"), "rep", "left")
               .select(F.col("doc").alias("doc_id"), F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_shingles"), F.when(F.coalesce("n", F.lit(0)) == 0, F.col("doc")).otherwise(F.coalesce("component", "rep")).alias("component_id")))
        lone = base.where("doc is null").select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc").alias("component_id"))
        return out.unionByName(lone)

    def link(self, texts: DataFrame, entries: DataFrame) -> DataFrame:
        heads = entries.groupBy("tok").agg(F.count("*").alias("c"), F.min("doc").alias("head"), F.min_by("n", "doc").alias("head_n")).where("c > 1")
        index = materialize(entries.join(heads, "tok"))
        stars = materialize(index.where(f"doc <> head and 100 * least(n, head_n) >= {self.num} * greatest(n, head_n)").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct())
        used = materialize(index.select("doc").distinct())
        sets = self.sets(texts.join(maybe_broadcast(used, used.count()), "doc", "left_semi"))
        first = self.verify(stars, sets)
        checked = first.select("a", "b", "both", "total")
        links = checked.where(f"100 * both >= {self.num} * total").select("a", "b")
        comps = connected_components(links)
        near = checked.groupBy(F.col("b").alias("doc")).agg(F.min_by(F.struct(F.col("a").alias("pivot"), (1 - F.col("both") / F.col("total")).alias("dist")), F.struct(1 - F.col("both") / F.col("total"), "a")).alias("s")).select("doc", "s.pivot", "s.dist")
        pivots = checked.select(F.col("a").alias("doc")).distinct().select("doc", F.col("doc").alias("pivot"), F.lit(0.0).alias("dist"))
        near = near.join(pivots.select("doc"), "doc", "left_anti").unionByName(pivots)
        # the closest linked pivot of each set, and the difference of the two
        close = first.where("minus is not null").groupBy(F.col("b").alias("doc")).agg(F.min_by(F.struct(F.col("a").alias("pivot"), "n", "minus", "plus"), F.struct(1 - F.col("both") / F.col("total"), "a")).alias("s"))
        close = materialize(close.select("doc", "s.pivot", "s.n", "s.minus", "s.plus"))
        facts = materialize(sets.select("doc", "bits").join(near, "doc", "left").select("doc", "bits", F.coalesce("pivot", F.lit(0)).alias("pivot"), F.coalesce("dist", F.lit(float("nan"))).alias("dist")))
        for every in (False, True):
            labelled = index.join(comps.withColumnRenamed("v", "doc"), "doc", "left").select("tok", "doc", "n", "pos", "c", F.coalesce("component", "doc").alias("comp"))
            open_lists = labelled.groupBy("tok").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("tok")
            blocks = F.ceil(F.col("c") / self.list_rows).cast("int")
            own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
            key = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda h: F.xxhash64("tok", F.least(own, h), F.greatest(own, h))))
            lists = (labelled.join(open_lists, "tok", "left_semi").select(key.alias("key"), "doc", "n", "pos", "comp").join(facts, "doc")
                     .repartition("key").sortWithinPartitions("key"))
            pairs = self.remaining(lists, every).join(checked.select("a", "b"), ["a", "b"], "left_anti")
            more = self.derive(pairs, sets, checked, close)
            checked = checked.unionByName(more)
            fresh = more.where(f"100 * both >= {self.num} * total").select("a", "b")
            if not fresh.isEmpty():
                links = links.unionByName(fresh)
                comps = connected_components(links)
        return comps


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; links at ``num`` percent of ``words``-word shingles. See
    ``Join.run`` for nulls, empty texts and repeats."""
    return Join(words, num).run(docs)
