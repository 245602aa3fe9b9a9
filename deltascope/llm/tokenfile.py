"""Token-id files with directly addressable codes (chunk levels, continuation bitmaps, rank directories)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Encoder, bound_batches, materialize, maybe_broadcast

#: Bits between two entries of a rank directory.
STEP = 512


def dac_encode(ids: np.ndarray, bits: int = 8) -> bytes:
    """Code ids (uint32) as levels of ``bits`` (8 or 16) wide chunks.

    Layout, little-endian: 'DAC1', chunk bits u8, levels u8, reserved u16, then per level: count u64, chunks, and,
    but for the last level, the continuation bitmap padded to whole steps and one u64 of ones before each step.
    """
    if bits not in (8, 16):
        raise ValueError("chunks are 8 or 16 bits wide")
    rest, levels = np.asarray(ids, dtype=np.uint64), []
    while True:
        chunk = (rest & np.uint64((1 << bits) - 1)).astype("<u1" if bits == 8 else "<u2")
        more = (rest >> np.uint64(bits)) > 0
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(bits)
    out = [struct.pack("<4sBBH", b"DAC1", bits, len(levels), 0)]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k < len(levels) - 1:
            padded = np.zeros(-(-len(more) // STEP) * STEP, bool)
            padded[: len(more)] = more
            ones = padded.reshape(-1, STEP).sum(1)
            out += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class Dac:
    """A coded block: ``len``, ``[i]`` for one id without decoding its neighbours, ``decode()`` for all."""

    def __init__(self, blob: bytes):
        magic, self.bits, n_levels, _ = struct.unpack_from("<4sBBH", blob)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 block")
        at, kind, self.levels = 8, np.dtype("<u1" if self.bits == 8 else "<u2"), []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunk = np.frombuffer(blob, kind, n, at + 8)
            at += 8 + n * kind.itemsize
            bitmap = ranks = None
            if k < n_levels - 1:
                steps = -(-n // STEP)
                bitmap = np.frombuffer(blob, "u1", steps * STEP // 8, at)
                ranks = np.frombuffer(blob, "<u8", steps, at + len(bitmap))
                at += len(bitmap) + 8 * steps
            self.levels.append((chunk, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (self.bits * k)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            step = i // STEP
            own = bitmap[step * STEP // 8 : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[step]) + int(np.bitwise_count(own).sum())
        return value

    def decode(self) -> np.ndarray:
        values = None
        for k, (chunk, bitmap, _) in reversed(list(enumerate(self.levels))):
            own = chunk.astype(np.uint64)
            if bitmap is not None:
                own[np.unpackbits(bitmap, bitorder="little")[: len(chunk)].astype(bool)] |= values << np.uint64(self.bits)
            values = own
        return values.astype("<u4")


def task_count(df: DataFrame, task_bytes: int = 32 << 20) -> list[int]:
    """The number of tasks for ``df`` if its estimated size asks for more than the session's number, else none: the
    planner then joins small ones."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = -(-size // task_bytes)
    return [n] if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1 << 24 else []


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """Tokenise ``docs`` in ascending doc_id order and write blocks of about ``block_ids`` ids to the shared folder.

    The file format is a Parquet dataset with one row per block: part, seq (order), doc_ids, lengths, ids (DAC1).
    Null ids come first; null texts are empty; repeated rows follow one another; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, seq = Encoder.get(vocabulary, lead=False), TaskContext.get().partitionId(), 0
        held, names, n, end = [], [], 0, np.array([end_id], "<u4")

        def block():
            return pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [n], "doc_ids": [[None if pd.isna(x) else int(x) for x in names]], "lengths": [[len(x) for x in held]], "ids": [dac_encode(np.concatenate(held))]})

        for b in batches:
            for d, own in zip(b["doc_id"], enc.encode_many(list(b["text"]))):
                held.append(np.concatenate([own.astype("<u4"), end]))
                names.append(d)
                n += len(held[-1])
                if n >= block_ids:
                    yield block()
                    held, names, n, seq = [], [], 0, seq + 1
        if held:
            yield block()

    bound_batches(docs.sparkSession, 8 << 20)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one doc_id, or without any, are dealt by their text's hash, so that they do not meet in one task
    ordered = own.withColumn("_h", F.xxhash64("text")).repartitionByRange(*task_count(own), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return materialize(ordered.select("doc_id", "text").mapInPandas(run, "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"))


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``at``, the number of ids before each. The ids stay where they are: a few numbers a block are
    summed, and travel to all executors if their size allows."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"), F.count("*").alias("_blocks"))
    parts = materialize(parts.select("part", "_blocks", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_at")))  # a row per task of the writer
    n, most = parts.agg(F.sum("_blocks"), F.count("*")).first()
    upto = Window.partitionBy("part").orderBy("seq")
    at = (blocks.select("part", "seq", (F.sum("n_ids").over(upto) - F.col("n_ids")).alias("_at"))
          .join(maybe_broadcast(parts.select("part", "_part_at"), most or 0), "part").select("part", "seq", (F.col("_at") + F.col("_part_at")).alias("at")))
    return blocks.join(maybe_broadcast(at, n or 0), ["part", "seq"])


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Read blocks back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of the little-endian u32 ids.

    One row for every row written, null and repeated doc_ids included (these in the order of their texts' hashes); no
    blocks give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, names, lengths, ids in zip(b["at"], b["doc_ids"], b["lengths"], b["ids"]):
                values, ends = Dac(ids).decode(), np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(starts, ends)]
                yield pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in names], "Int64"), "start": starts + at, "n_tokens": lengths, "ids_crc32": crcs})

    return placed_blocks(blocks).select("at", "doc_ids", "lengths", "ids").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, i, token) of each distinct (doc_id, i) of ``places``: the i-th id of a document, straight from the levels and
    rank directories of its block, which is not decoded. Null where there is no such document or place; of documents
    that repeat a doc_id, the first in the files answers. Null doc_ids match each other."""
    index = blocks.select("part", "seq", F.posexplode("doc_ids").alias("k", "doc_id"), "lengths")
    before = F.aggregate(F.slice("lengths", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    index = index.select("doc_id", F.struct("part", "seq", "k", before.alias("first"), F.element_at("lengths", F.col("k") + 1).alias("n")).alias("at")).groupBy("doc_id").agg(F.min("at").alias("at"))
    asked = places.select(F.col("doc_id").cast("long").alias("_d"), F.col("i").cast("long").alias("i")).distinct()
    found = asked.join(index, F.col("_d").eqNullSafe(F.col("doc_id")), "left").select(F.col("_d").alias("doc_id"), "i", "at.part", "at.seq", F.when((F.col("i") >= 0) & (F.col("i") < F.col("at.n")), F.col("at.first") + F.col("i")).alias("x"))
    # a block and at most 4,096 places of it make one row
    lots = found.where("x is not null").groupBy("part", "seq", F.expr("x div 4096").alias("lot")).agg(F.collect_list(F.struct("doc_id", "i", "x")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, asked in zip(b["ids"], b["asked"]):
                block = Dac(ids)
                yield pd.DataFrame({"doc_id": pd.array([x["doc_id"] for x in asked], "Int64"), "i": [x["i"] for x in asked], "token": pd.array([block[x["x"]] for x in asked], "Int64")})

    out = blocks.select("part", "seq", "ids").join(lots, ["part", "seq"]).select("ids", "asked").mapInPandas(run, "doc_id long, i long, token long")
    return out.unionByName(found.where("x is null").select("doc_id", "i", F.lit(None).cast("long").alias("token")))
