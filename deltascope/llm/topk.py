"""Exact top-k inner-product search with one KD-tree per shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize

HIT = "query_id long, vec_id long, score long"


class KDTree:
    """Median splits on the widest side; every node keeps the tight box of its own points and a run of rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 64):
        order, self.nodes = np.lexsort((ids,)), []
        lo, hi, todo = [], [], [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            lo.append(own.min(0))
            hi.append(own.max(0))
            me = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            widths = hi[-1] - lo[-1]
            if b - a > leaf and widths.max() > 0:
                axis, mid = int(widths.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid, kind="introselect")]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.ids, self.points, self.lo, self.hi = ids[order], points[order], np.array(lo), np.array(hi)

    def search(self, queries: np.ndarray, qids: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        """Best (score, vec_id) of each query that reach its ``kth`` score so far. Visits boxes from the highest
        bound on the inner product down and stops when the next bound is below the k-th score."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = up @ self.hi.T + down @ self.lo.T
        found = []
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
            floor, own, heap = kth[q], bounds[q], [(-bounds[q, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < floor:
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-own[left], left))
                    heapq.heappush(heap, (-own[right], right))
                    continue
                scores = self.points[a:b] @ queries[q]
                for i in np.flatnonzero((scores >= floor) & (self.ids[a:b] != qids[q])):
                    hit = (scores[i], -self.ids[a + i])
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            kth[q] = floor
            found.append([(int(s), -int(v)) for s, v in best])
        return found


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    """Integer components; float64 where every product sum stays exact, else Python integers."""
    exact = np.array([np.asarray(x, dtype=np.int64) for x in frame["v"]])
    return exact.astype(np.float64) if float(np.abs(exact.astype(np.float64)).max(initial=0)) ** 2 * exact.shape[1] < 2**52 else exact.astype(object)


def quantize(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v = floor(scale * x) as longs, n = dimension. Null ids, null, empty and non-finite vectors drop out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("embedding").alias("n"))


def top_k(points: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """The ``k`` highest inner products of each query row (vec_id divisible by ``every``) over all other rows.

    ``points`` has vec_id, v (array<long>), n. Ties go to the smaller vec_id; only vectors of one length meet;
    rows with the query's own vec_id are no candidates. A repeated query row counts once, a repeated candidate row as
    often as it stands there; rows of one vec_id with different vectors are one query, whose answers are the best over
    all its vectors. Returns query_id, rank, vec_id, score; empty in, empty out; extra columns are dropped. Each block of
    queries first searches one shard; the k-th scores found there travel with its queries to the shards whose root
    box can still reach them, and to no others.
    """
    bound_batches(points.sparkSession)
    counts = {r["n"]: (r["c"], r["q"]) for r in points.groupBy("n").agg(F.count("*").alias("c"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}  # a row per dimension
    shards = max([1, *(-(-c // shard_rows) for c, _ in counts.values())])
    blocks = max([1, *(-(-q // block_rows) for _, q in counts.values())])

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree(frame["vec_id"].to_numpy(), _matrix(frame))
        return pd.DataFrame({"n": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, 5)], "box": [pickle.dumps((tree.lo[0], tree.hi[0]), 5)]})

    def gather(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        blob = pickle.dumps((frame["vec_id"].to_numpy(), _matrix(frame), np.full(len(frame), -np.inf)), 5)
        return pd.DataFrame({"n": [key[0]], "block": [key[1]], "queries": [blob]})

    def hits(tree: KDTree, ids, q, kth) -> pd.DataFrame:
        if tree.points.dtype != q.dtype:
            tree.points, tree.lo, tree.hi, q = (x.astype(object) for x in (tree.points, tree.lo, tree.hi, q))
        rows = [(int(i), v, s) for i, own in zip(ids, tree.search(q, ids, k, kth)) for s, v in own]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    trees = materialize(points.groupBy("n", shard.alias("shard")).applyInPandas(build, "n int, shard int, tree binary, box binary"))
    queries = points.where(F.col("vec_id") % every == 0).dropDuplicates().groupBy("n", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).applyInPandas(gather, "n int, block int, queries binary")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, shard, tree, blob in zip(b["n"], b["shard"], b["tree"], b["queries"]):
                ids, q, kth = pickle.loads(blob)
                own = hits(pickle.loads(tree), ids, q, kth)
                yield pd.DataFrame({"n": [n], "home": [shard], "queries": [pickle.dumps((ids, q, kth), 5)], "hits": [pickle.dumps(own, 5)]})

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries of a block that a shard can still answer: its root's bound reaches their kth score."""
        for b in batches:
            for n, home, blob, boxes in zip(b["n"], b["home"], b["queries"], b["boxes"]):
                ids, q, kth = pickle.loads(blob)
                for x in boxes:
                    lo, hi = pickle.loads(x["box"])
                    if lo.dtype != q.dtype:
                        lo, hi, own = lo.astype(object), hi.astype(object), q.astype(object)
                    else:
                        own = q
                    left = np.maximum(own, 0) @ hi + np.minimum(own, 0) @ lo >= kth
                    if x["shard"] != home and left.any():
                        yield pd.DataFrame({"n": [n], "shard": [x["shard"]], "kind": [1], "blob": [pickle.dumps((ids[left], q[left], kth[left]), 5)]})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, own = None, None
        for b in batches:
            for n, shard, kind, blob in zip(b["n"], b["shard"], b["kind"], b["blob"]):
                if kind == 0:
                    tree, own = pickle.loads(blob), (n, shard)
                elif own != (n, shard):
                    raise RuntimeError("a block of queries came before its tree")
                else:
                    yield hits(tree, *pickle.loads(blob))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["hits"]:
                yield pickle.loads(blob)

    # Rarer lengths leave shards empty: a block's home is one of the trees that its own length has.
    held = trees.select("n", "shard", (F.row_number().over(Window.partitionBy("n").orderBy("shard")) - 1).alias("at"))
    home = queries.join(held.groupBy("n").agg(F.count("*").alias("own")), "n").withColumn("at", F.expr("pmod(block, own)").cast("int")).join(held, ["n", "at"])
    seeded = materialize(home.join(trees.select("n", "shard", "tree"), ["n", "shard"]).select("n", "shard", "tree", "queries").mapInPandas(first, "n int, home int, queries binary, hits binary"))
    # Blocks meet the root boxes of the shards, 256 at a time; then each tree is read by one task, which holds one tree,
    # and the blocks of queries that it can answer stream through it.
    boxes = trees.groupBy("n", F.expr("shard div 256").alias("_lot")).agg(F.collect_list(F.struct("shard", "box")).alias("boxes"))
    wanted = seeded.join(boxes, "n").select("n", "home", "queries", "boxes").mapInPandas(reach, "n int, shard int, kind int, blob binary")
    cells = (wanted.unionByName(trees.select("n", "shard", F.lit(0).alias("kind"), F.col("tree").alias("blob")))
             .repartition(max(1, min(shards * len(counts), 1 << 16)), "n", "shard").sortWithinPartitions("n", "shard", "kind"))
    found = seeded.select("hits").mapInPandas(unpack, HIT).unionByName(cells.mapInPandas(rest, HIT))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
