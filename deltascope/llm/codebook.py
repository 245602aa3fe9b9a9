"""Codes of vector parts: codebooks by rounds of assignment and means, nearest entries found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, maybe_broadcast


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is there and holds finite numbers only: vec_id, label (null where there is no such
    column), embedding as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label, v.alias("embedding"))


def _whole(x: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x): long where squares of differences stay exact, else Python integers."""
    y = np.floor(x * scale)
    return y.astype(np.int64) if np.abs(y).max(initial=0) < 2**25 else np.array([int(c) for c in y.ravel()], object).reshape(y.shape)


def _limbs(x: int) -> list[int]:
    """``x`` in signed digits of 40 bits, lowest first, so that sums of many tasks stay within longs."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & ((1 << 40) - 1)))
        x >>= 40
    return out


class Entries:
    """The entries of one part's codebook in order of their norm."""

    def __init__(self, rows: list[list[int]]):
        exact = np.array(rows, object).reshape(len(rows), -1)
        self.small = bool(np.abs(exact).max(initial=0) < 2**25) and exact.shape[1] < 1 << 10
        self.exact = exact.astype(np.int64) if self.small else exact
        norms = np.sqrt((exact.astype(np.float64) ** 2).sum(1))
        self.order = np.lexsort((np.arange(len(rows)), norms))
        self.norms, self.sorted = norms[self.order], self.exact[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (the lowest of ties) and squared distance of each row's nearest entry.

        An entry nearer than d has a norm within d of the row's own. The entry of the closest norm gives the first d, a
        binary search the interval of norms that d allows; its entries are evaluated from the row's norm outwards, and
        a side ends as soon as its next norm lies outside of the annulus that the best distance so far leaves. The
        border counts as inside, with room for rounding of the norms; distances are whole numbers.
        """
        if not (self.small and x.dtype != object):
            x = x.astype(object)
        points = self.sorted if x.dtype != object else self.sorted.astype(object)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        n, k = len(x), len(self.norms)
        room = 1e-9 * (1.0 + norms)
        at = np.clip(np.searchsorted(self.norms, norms), 0, k - 1)
        at -= (at > 0) & (np.abs(self.norms[at - 1] - norms) < np.abs(self.norms[at] - norms))
        best = ((x - points[at]) ** 2).sum(1)
        index = self.order[at].copy()
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + room
        low = np.searchsorted(self.norms, norms - reach, "left")
        high = np.searchsorted(self.norms, norms + reach, "right")
        for step, ends in ((-1, low), (1, high)):
            rows, place = np.arange(n), at + step
            while True:
                open_ = (place >= ends[rows]) if step < 0 else (place < ends[rows])
                rows, place = rows[open_], place[open_]
                if len(rows):
                    inside = np.abs(self.norms[place] - norms[rows]) <= reach[rows]
                    rows, place = rows[inside], place[inside]
                if not len(rows):
                    break
                far = ((x[rows] - points[place]) ** 2).sum(1)
                own = self.order[place]
                won = ((far < best[rows]) | ((far == best[rows]) & (own < index[rows]))).astype(bool)
                hit = rows[won]
                best[hit], index[hit] = far[won], own[won]
                reach[hit] = np.sqrt(far[won].astype(np.float64)) * (1 + 1e-9) + room[hit]
                place = place + step
        return index, best


def _batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Each batch with its vectors by dimension: (dimension, rows, whole numbers)."""
    for b in batches:
        column = b.column(b.schema.get_field_index("embedding"))
        lengths = np.diff(column.offsets.to_numpy())
        flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            cells = flat.reshape(len(rows), n) if len(rows) == len(lengths) else flat[(at[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
            out.append((n, rows, _whole(cells)))
        yield b, out


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> dict[int, list[list[list[int]]]]:
    """Codebooks by dimension, part and entry: they start as the parts of the vectors with the smallest ids, and each
    round makes an entry the floor of the mean of the parts nearest to it. ``rows`` as of ``usable``, every dimension a
    multiple of ``parts``. On the driver are only codebooks (``parts`` x ``entries`` entries a dimension)."""
    start: dict[int, list[list[list[int]]]] = {}
    for (n,) in rows.select(F.size("embedding")).distinct().collect():  # a row per dimension
        first = rows.where(F.size("embedding") == n).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
        cells = [_whole(np.array(r["embedding"], np.float64).reshape(1, -1))[0].tolist() for r in first]
        start[n] = [[c[p * n // parts : (p + 1) * n // parts] for c in cells] for p in range(parts)]
    books = start

    def sums(books):
        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tools = {n: [Entries(part) for part in book] for n, book in books.items()}
            counts = {n: np.zeros((parts, len(book[0])), np.int64) for n, book in books.items()}
            totals = {n: np.zeros((parts, len(book[0]), n // parts), object) for n, book in books.items()}
            for _, own in _batches(batches, parts):
                for n, _, x in own:
                    w = n // parts
                    for p in range(parts):
                        piece = x[:, p * w : (p + 1) * w]
                        index, _ = tools[n][p].nearest(piece)
                        counts[n][p] += np.bincount(index, minlength=counts[n].shape[1])
                        if piece.dtype == object:
                            np.add.at(totals[n][p], index, piece)
                        else:
                            part = np.zeros(totals[n][p].shape, np.int64)
                            np.add.at(part, index, piece)
                            totals[n][p] += part
            out = [(n, p, e, c, limb, int(counts[n][p, e]), x) for n in counts for p, e in zip(*np.nonzero(counts[n])) for c in range(n // parts) for limb, x in enumerate(_limbs(int(totals[n][p, e, c])))]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:5]] + [pa.array(c, pa.int64()) for c in cols[5:]], ["n", "part", "entry", "place", "limb", "members", "total"])

        return per_task

    for _ in range(rounds):
        summed = (rows.select("embedding").mapInArrow(sums(books), "n int, part int, entry int, place int, limb int, members long, total long")
                  .groupBy("n", "part", "entry", "place", "limb").agg(F.sum("members").alias("members"), F.sum("total").alias("total")))
        totals: dict[tuple[int, int, int, int], list[int]] = {}
        for r in summed.collect():  # at most the numbers of the codebooks, in limbs
            own = totals.setdefault((r["n"], r["part"], r["entry"], r["place"]), [0, 0])
            own[0] += r["total"] << (40 * r["limb"])
            own[1] = max(own[1], r["members"])  # the lowest limb comes from every task that has members
        after = {n: [[list(e) for e in part] for part in book] for n, book in books.items()}
        for (n, p, e, c), (total, members) in totals.items():
            after[n][p][e][c] = total // members
        books = after
    return books


def encode(rows: DataFrame, books: dict[int, list[list[list[int]]]], parts: int = 4) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance over all parts), codebooks_sha256."""
    digest = {n: hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest() for n, book in books.items()}
    label = rows.schema["label"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {n: [Entries(part) for part in book] for n, book in books.items()}
        for b, own in _batches(batches, parts):
            codes, errors, shas = [""] * b.num_rows, [0] * b.num_rows, [""] * b.num_rows
            for n, at, x in own:
                w, code, error = n // parts, [], 0
                for p in range(parts):
                    index, far = tools[n][p].nearest(x[:, p * w : (p + 1) * w])
                    code.append(index.astype(np.uint8))
                    error = error + far
                for i, c, e in zip(at.tolist(), np.stack(code, 1), error.tolist()):
                    codes[i], errors[i], shas[i] = c.tobytes().hex(), min(int(e), 2**63 - 1), digest[n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes), pa.array(errors, pa.int64()), pa.array(shas)], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(per_batch, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, salts: int = 64) -> DataFrame:
    """Codes of all ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(1024 * x). Rows without a vector, or with a null or non-finite component, drop out; so do
    vectors that cannot be cut into ``parts`` equal parts. Vectors of different dimensions have codebooks of their own;
    with fewer than ``entries`` (at most 256) vectors a codebook is as short. Repeated rows count as often as they stand
    there, null ids come last among the first ones, a missing or null label is one label; an empty table gives no rows.
    An error beyond a long is its largest value, a sum of errors beyond it null. Other columns go. A round reads the
    vectors once and shuffles a row a codebook number and task. Errors of a label are summed in two steps and joined
    by (label, salt), so that no label meets in one task.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors).where(F.size("embedding") % parts == 0)
    coded = materialize(encode(rows, fit(rows, parts, entries, rounds), parts))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    sums = sums.withColumn("_key", F.col("label")).drop("label")
    count = sums.count()
    small = maybe_broadcast(sums, count)
    if small is not sums:
        joined = salted.join(small, F.col("label").eqNullSafe(F.col("_key")), "left")
    else:
        spread = sums.withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, F.col("label").eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_own")), "left")
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of ``compress`` for vectors of one dimension."""
    steps = [f"""
k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT rid, p, v[1 + p * len(v) // {parts} : (p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT p, e, x AS y FROM f JOIN c USING (rid))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, c.p, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m FROM c JOIN b{r} b ON b.p = c.p GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT p, e, list(w ORDER BY i) AS y FROM (SELECT c.p, m.e AS e, i, CAST(floor(sum(x[i])::HUGEINT / count(*)) AS BIGINT) AS w FROM c JOIN a{r} a USING (rid, p), range(1, len(x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.y, b.y) AS y FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e)""")
    steps.append(f"""
o AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (rid), h""")
    return "WITH " + ",".join(steps)
