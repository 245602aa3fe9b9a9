"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A local one is made only where it is unset and the session is
    local (tests); a cluster without the setting is an error, since its machines share no other folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(scratch_dir, "own", None)
        if place is None:
            place = scratch_dir.own = "file://" + tempfile.mkdtemp(prefix="deltascope-")
    return place.rstrip("/")


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: lineage is cut, executors may be lost.

    ``rows``, an upper bound of the row count, sizes the number of tasks and files (100,000 rows each at most). The
    table goes when the session's JVM ends; results that are still read may depend on it until then.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // 100_000)
    path = f"{scratch_dir(spark)}/deltascope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Python workers get at most about ``most_bytes`` at a time (or one row, if it is larger). The session's limit is
    only ever lowered, so that queries of one session do not disturb each other."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > most_bytes:
        spark.conf.set(name, str(most_bytes))


def word_count(col):
    """Number of maximal runs of non-space characters (contract white space); null counts 0."""
    parts = F.split(F.coalesce(col, F.lit("")), SPACE)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
            - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def maybe_broadcast(df: DataFrame, rows: int, most_bytes: int = 32 << 20, text_bytes: int = 64) -> DataFrame:
    """Broadcast hint only if the counted rows stay below ``most_bytes``; otherwise Spark plans a shuffle join. A row counts
    8 bytes a column and ``text_bytes`` a string or binary one, and twice that for the table that the hash join builds.
    Columns of unbounded width need a measured ``text_bytes``."""
    width = 2 * sum(text_bytes if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema)
    return F.broadcast(df) if rows * max(16, width) <= most_bytes else df


#: What Python workers keep from task to task, by operator.
_held: dict[str, object] = {}


def held(owner: str, make):
    """The cache of ``owner`` in this worker, made anew if another operator ran in between: a reused worker holds the
    caches of one operator at a time."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def trim() -> None:
    """Give freed memory of this worker back to the machine, where the C library can."""
    import ctypes

    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def two_level_rank(rows: DataFrame, keys: list[str], salt: Column, order: list, buckets: int, name: str) -> DataFrame:
    """Add ``name``, the rank from 1 of each row among those of like ``keys`` (null equals null). A row's bucket is ``salt``
    modulo ``buckets``; ranks within a bucket add to the sizes of the buckets before it, so that no hot key is ordered in
    one task."""
    cut = rows.withColumn("_bucket", F.pmod(salt, F.lit(buckets)))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"),
                          (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_size")).alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(before, same).select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


class Encoder:
    """Exact ids of a public vocabulary through a cache of space-delimited chunks.

    Both public pre-tokenizers split at single white space, so a text's ids are the ids of its chunks one after another.
    ``lead`` keeps the space in front of a chunk and the line feeds (byte-level BPE); texts whose white space is not
    plain single separators go through the library whole. New chunks are encoded together, told apart by a separator of
    one known id. A full cache (``most`` chunks of at most ``longest`` characters) stays as it is until four times as many
    chunks were not found in it. A text that spells a special token goes through the library whole, which gives that
    token's id; with ``plain_specials`` such text is text like any other.
    """

    #: White space other than space and line feed, and the mark of a chunk without a space in front.
    _odd_lead = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _odd_drop = re.compile(r"[\x1c-\x1f\x85]")

    def __init__(self, path: str, lead: bool, most: int = 500_000, longest: int = 64, plain_specials: bool = False, lot: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # looking for special tokens costs the library time in every text; only texts that spell one need it
        self.tok.encode_special_tokens = True
        self.lead, self.most, self.longest, self.lot, self.cache, self.missed = lead, most, longest, lot, {}, 0
        added = [] if plain_specials else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        # signs that all of them begin with, found faster than the pattern
        self.sign = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0] if added else ""
        self.mark = "\n" if lead else "~"
        # a chunk of letters is one token run: its first token alone holds the space, its last alone the end of the word
        size = self.tok.get_vocab_size()
        self.edge = np.array([(t.startswith("\u0120") if lead else t.endswith("</w>")) for t in (self.tok.id_to_token(i) or "" for i in range(size))])
        (self.mark_id,) = self.tok.encode(self.mark, add_special_tokens=False).ids

    @classmethod
    def get(cls, path: str, lead: bool, lean: bool = False) -> "Encoder":
        """This worker's encoder; a ``lean`` one works on smaller lots and caches less."""
        return held(f"encoder {path} {lead} {lean}", lambda: cls(path, lead, 400_000, lot=1_000_000) if lean else cls(path, lead))

    def _spells_special(self, text: str) -> bool:
        return self.special is not None and self.sign in text and self.special.search(text) is not None

    def _odd(self, text: str) -> bool:
        if self._spells_special(text):
            return True
        if not self.lead:
            return self._odd_drop.search(text) is not None
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or self._odd_lead.search(text) is not None

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. A full stop or comma after a letter is a token run of its own, so such a chunk is put
        together from the ids of its word and of the sign."""
        split = {c: c[:-1] for c in chunks if c[-1] in ".," and len(c) > 1 and c[-2].isalpha() and (self.lead or self._ends_in_letter(c[:-1]))}
        mark = "\x00" if self.lead else ""
        bases = {b for b in split.values() if b not in self.cache}
        out = self._together([c for c in {*chunks, *bases, mark + ".", mark + ","} if c not in split])
        for c, b in split.items():
            out[c] = (out[b] if b in out else self.cache[b]) + out[mark + c[-1]]
        return out

    @staticmethod
    def _ends_in_letter(word: str) -> bool:
        """Whether a word still ends in a letter, and not in a mark, once the library has composed it and made it small."""
        return word.isascii() or unicodedata.normalize("NFC", word).lower()[-1].isalpha()

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        letters = [c for c in chunks if c.isalpha()]
        if len(letters) > 1:
            out = {}
            for k in range(0, len(letters), 4000):
                part = letters[k : k + 4000]
                ids = self._whole((" " if self.lead else "") + " ".join(part))
                cut = np.flatnonzero(self.edge[ids])
                ends = np.append(cut[1:], len(ids)) if self.lead else cut + 1
                if len(cut) != len(part) or (cut[0] != 0 if self.lead else ends[-1] != len(ids)):
                    out.update((c, self._whole(" " + c if self.lead else c).tobytes()) for c in part)
                    continue
                raw, at = ids.tobytes(), 0
                for c, e in zip(part, ends.tolist()):
                    out[c] = raw[2 * at : 2 * e]
                    at = e
            return out | self._together([c for c in chunks if not c.isalpha()])
        out = {"\n": np.asarray([self.mark_id], "<u2").tobytes()} if self.lead else {}
        plain = [c for c in chunks if c != "\n"] if self.lead else [c for c in chunks if "~" not in c]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            if self.lead:
                ids = self._whole("\n".join([c[1:] if c[0] == "\x00" else " " + c for c in part]))
            else:
                ids = self._whole(" ~ ".join(part))
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(part) - 1:
                out.update((c, self._whole((c[1:] if c[0] == "\x00" else " " + c) if self.lead else c).tobytes()) for c in part)
                continue
            raw, ends = ids.tobytes(), np.append(cut, len(ids)).tolist()
            at = 0
            for c, e in zip(part, ends):
                out[c] = raw[2 * at : 2 * e]
                at = e + 1
        if not self.lead:
            out.update((c, self._whole(c).tobytes()) for c in chunks if "~" in c)
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as little-endian uint16 (both vocabularies have fewer than 65,536 ids)."""
        out: list = [np.zeros(0, "<u2")] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._odd(text):
                self.tok.encode_special_tokens = not self._spells_special(text)
                out[i] = self._whole(text)
                self.tok.encode_special_tokens = True
                continue
            held.append((i, ("\x00" + text.replace("\n", " \n \x00")).split(" ") if self.lead else text.split()))
            size += len(text)
            if size > self.lot:
                self._join(held, out)
                held, size = [], 0
        self._join(held, out)
        return out

    def _join(self, held: list, out: list) -> None:
        seen: set = set()
        for _, chunks in held:
            seen.update(chunks)
        new = seen.difference(self.cache)
        own = self._new(list(new)) if new else {}
        short = {c: x for c, x in own.items() if len(c) <= self.longest}
        if len(self.cache) + len(short) > self.most:
            self.missed += len(short)
            if self.missed > 4 * self.most:
                self.cache.clear()
                self.missed = 0
        kept = self.cache
        # chunks of this lot only: a small table, so that the many look-ups below stay near the processor
        local = {c: kept[c] for c in seen.difference(own) if c in kept}
        if len(kept) + len(short) <= self.most:
            kept.update(short)
        local.update(own)
        if len(local) < len(seen):
            local.update(self._new([c for c in seen if c not in local]))
        get = local.__getitem__
        for i, chunks in held:
            out[i] = np.frombuffer(b"".join(map(get, chunks)), "<u2")
