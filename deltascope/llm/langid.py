"""Language identification of mixed-language texts: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held, trim
from .shingles import word_hashes

# First and last code point of each script's main blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
#: A word; longer runs of letters are scored in pieces of 64 letters.
_WORD = re.compile(r"[^\W\d_]{1,64}")
_GAP = re.compile(r"[\W\d_]")
BUCKETS = 1 << 16
#: The bounded sample of labelled documents is counted by so many tasks.
TASKS = 8
UND = "und"


def script_of(word: str) -> str:
    c = ord(word[0])
    for name, ranges in SCRIPTS.items():
        if any(a <= c <= b for a, b in ranges):
            return name
    return "other"


_scripts: dict[str, str] = {}


def _script(word: str) -> str:
    out = _scripts.get(word[0])
    if out is None:
        if len(_scripts) > 50_000:
            _scripts.clear()
        out = _scripts[word[0]] = script_of(word)
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of words: the hash buckets of a word itself and of its byte 2- to 4-grams with boundary marks.

    Returns buckets (4 rows: word, 2-, 3- and 4-grams, one column a byte of the marked words), which of them count, and
    where each word begins."""
    text = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    starts = np.flatnonzero(text == 0x3C)
    lengths = np.diff(starts, append=len(text))
    left = np.repeat(starts + lengths, lengths) - np.arange(len(text))  # bytes to the end of the word
    buckets, used = np.zeros((4, len(text)), np.int64), np.zeros((4, len(text)), bool)
    buckets[0, starts] = (word_hashes([" ".join(words)], 1 << 62)[0] >> np.uint64(48)).astype(np.int64)
    used[0, starts] = True
    gram = text.copy()
    for n in (2, 3, 4):
        gram[: len(text) - n + 1] = gram[: len(text) - n + 1] * np.uint32(257) + text[n - 1 :]
        buckets[n - 1] = ((gram * np.uint32(4) + np.uint32(n - 2)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        used[n - 1] = left >= n
    return buckets, used, starts


@dataclass
class Model:
    """Log-probabilities of features by language and, for each script, the languages that use it."""

    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages
    scripts: dict[str, np.ndarray]
    penalty: float = 6.0

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words in each language, relative to the best, over the candidates that their scripts leave."""
        buckets, used, starts = features(words)
        sums = np.zeros((len(words), len(self.langs)), np.float32)
        for own, valid in zip(buckets, used):
            sums += np.add.reduceat(self.scores[own] * valid[:, None], starts)
        counts = np.add.reduceat(used.sum(0), starts)
        own = sums * (np.minimum([len(w) + 1 for w in words], 8) / counts)[:, None].astype(np.float32)
        every = np.ones(len(self.langs), bool)
        masks = {s: x if x.any() else every for s, x in self.scripts.items()}
        allowed = np.array([masks.get(_script(w), every) for w in words])
        own = np.where(allowed, own, own.max(1, keepdims=True) - np.float32(50.0))
        return own - own.max(1, keepdims=True)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word for texts side by side. ``scores``: texts x words x languages, texts longest first."""
    n, steps, k = scores.shape
    kind = np.int8 if k <= 127 else np.int32
    best, back = scores[:, 0].copy(), np.zeros((n, steps, k), kind)
    for t in range(1, steps):
        m = int(np.searchsorted(-lengths, -t, side="left"))  # texts that still have a word here
        top = best[:m].argmax(1)
        jump = best[np.arange(m), top][:, None] - penalty
        stay = best[:m] >= jump
        back[:m, t] = np.where(stay, np.arange(k, dtype=kind), top[:, None].astype(kind))
        best[:m] = np.where(stay, best[:m], jump) + scores[:m, t]
    labels, at = np.zeros((n, steps), kind), best.argmax(1)
    for t in range(steps - 1, -1, -1):
        live = lengths > t
        labels[live, t] = at[live]
        if t:
            at[live] = back[np.arange(n)[live], t, at[live]]
    return labels


def constant_label(scores: np.ndarray, penalty: float) -> int | None:
    """The label that all words share, if that is the best path: no run of words gains more by other labels than the
    switches there and back (one switch at either end of the text) cost. None if the search has to tell."""
    best = int(scores.sum(0, dtype=np.float64).argmax())
    if scores.shape[1] == 1:
        return best
    rivals = scores.copy()
    rivals[:, best] = -np.inf
    gain = np.concatenate([[0.0], np.cumsum(rivals.max(1) - scores[:, best], dtype=np.float64)])
    within = (gain - np.minimum.accumulate(gain)).max()
    return best if within < 2 * penalty and gain.max() < penalty and gain[-1] - gain.min() < penalty else None


def train(docs: DataFrame, most_rows: int = 4000, penalty: float = 6.0) -> Model:
    """Naive Bayes over word features from about ``most_rows`` labelled documents of each language (those whose hashed id
    is smallest), none with crc32(doc_id) mod 4 = 2. Null and empty texts, null ids and languages teach nothing. The
    features are counted by TASKS tasks and summed by language; one row of BUCKETS counts a language, the size of
    the model, reaches the driver.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2").select("lang", "text", F.xxhash64("doc_id").alias("_h"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    # a threshold on 63 bits of the hash keeps about most_rows documents a language without a sort, whatever their number
    share = F.lit(False)
    for lang, n in sizes.items():
        low = F.lit(True) if n <= most_rows else F.shiftrightunsigned("_h", 1) < F.lit((most_rows << 63) // n)
        share = share | ((F.col("lang") == lang) & low)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                own = words.setdefault(lang, Counter())
                for part in _slices(text, 1_000_000):
                    own.update(_WORD.findall(part.lower()))
        rows = []
        for lang, own in words.items():
            sums, uses, items = np.zeros(BUCKETS), Counter(), list(own.items())
            for k in range(0, len(items), 20_000):
                buckets, used, starts = features([w for w, _ in items[k : k + 20_000]])
                times = np.repeat([n for _, n in items[k : k + 20_000]], np.diff(starts, append=used.shape[1]))
                for x, valid in zip(buckets, used):
                    sums += np.bincount(x[valid], times[valid], BUCKETS)
            for w, n in items:
                uses[script_of(w)] += n
            rows.append((lang, sums.astype(np.int64).tobytes(), "\n".join(f"{x}\t{n}" for x, n in uses.items())))
        yield pd.DataFrame(rows, columns=["lang", "counts", "scripts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(x, np.int64) for x in frame["counts"]], axis=0)
        return pd.DataFrame({"lang": frame["lang"][:1], "counts": [sums.tobytes()], "scripts": ["\n".join(x for x in frame["scripts"] if x)]})

    kind = "lang string, counts binary, scripts string"
    partial = labelled.where(share).select("lang", "text").repartition(TASKS).mapInPandas(count, kind)
    totals: dict[str, np.ndarray] = {}
    scripts: dict[str, dict[str, int]] = {}
    for r in partial.groupBy("lang").applyInPandas(add, kind).collect():  # a row for each language
        totals[r["lang"]] = np.frombuffer(r["counts"], np.int64)
        for line in r["scripts"].splitlines():
            s, n = line.split("\t")
            own = scripts.setdefault(s, {})
            own[r["lang"]] = own.get(r["lang"], 0) + int(n)
    if set(totals) != set(sizes):
        raise RuntimeError(f"no sample of the languages {sorted(set(sizes) - set(totals))}")
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {})
    counts = np.array([totals[x] for x in langs], np.float64) + 0.1
    words = {lang: sum(s.get(lang, 0) for s in scripts.values()) for lang in langs}
    return Model(langs, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)), {s: np.array([own.get(x, 0) > 0.001 * words[x] for x in langs]) for s, own in scripts.items()}, penalty)


def _slices(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of ``size`` characters and what is left of the last word."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Labeller:
    """Labels texts with a model. Memory is bounded by characters and words, not by texts; nothing is kept between calls."""

    def __init__(self, model: Model, lot: int = 500_000, cells: int = 4_000_000):
        """``lot``: characters that are taken apart into words at a time; ``cells``: scores (words x languages) that wait for
        their labels at a time. A longer text is taken apart in parts, but labelled at once."""
        self.model, self.lot, self.cells = model, lot, cells

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and lengths of ``words``."""
        if not words:
            return np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32)
        at = dict.fromkeys(words)
        seen = list(at)
        at.update(zip(seen, range(len(seen))))
        rows = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        step = max(1, 1_600_000 // len(self.model.langs))
        scores = np.concatenate([self.model.words(seen[k : k + step]) for k in range(0, len(seen), step)])
        return scores[rows], np.fromiter(map(len, seen), np.int32, len(seen))[rows]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; spans are (first word, end word, language) of like-labelled runs.

        The language holds the most letters; its score is that share of letters times the words' mean odds for it.
        """
        out: list = [(UND, 0.0, [])] * len(texts)
        if not self.model.langs:
            return out
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []  # texts whose labels may change within
        held, lot, size = 0, [], 0
        for i, t in [*enumerate(texts), (-1, None)]:
            if i >= 0 and not t:
                continue
            if lot and (i < 0 or size + len(t) > self.lot):
                for x in self._taken_apart(texts, lot, out):
                    waiting.append(x)
                    held += x[1].size
                lot, size = [], 0
            if held > self.cells or (i < 0 and waiting):
                self._place(waiting, out)
                waiting, held = [], 0
            if i >= 0:
                lot.append(i)
                size += len(t)
        return out

    def _taken_apart(self, texts: list, lot: list[int], out: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, scores, lengths) of the texts of a lot that need the search; the others are placed at once."""
        if len(lot) == 1:  # perhaps a very long text: never all its words at once
            parts = [self._scores(_WORD.findall(x.lower())) for x in _slices(texts[lot[0]], self.lot)]
            scores, sizes = (np.concatenate(x) for x in zip(*parts))
            ends = np.array([len(sizes)])
        else:
            words = [_WORD.findall(texts[i].lower()) for i in lot]
            ends = np.cumsum([len(x) for x in words])
            scores, sizes = self._scores([w for x in words for w in x])
        a = 0
        for i, z in zip(lot, ends.tolist()):
            if z > a:
                best = constant_label(scores[a:z], self.model.penalty)
                if best is None:
                    yield i, scores[a:z].copy(), sizes[a:z]
                else:
                    out[i] = self._answer(np.full(z - a, best), scores[a:z], sizes[a:z])
            a = z

    def _place(self, waiting: list, out: list) -> None:
        waiting.sort(key=lambda x: -len(x[2]))
        k = len(self.model.langs)
        while waiting:
            longest = len(waiting[0][2])
            group, waiting = waiting[: max(1, self.cells // (longest * k))], waiting[max(1, self.cells // (longest * k)) :]
            lengths = np.array([len(x[2]) for x in group])
            padded = np.zeros((len(group), longest, k), np.float32)
            for r, (_, scores, sizes) in enumerate(group):
                padded[r, : len(sizes)] = scores
            labels = viterbi(padded, lengths, self.model.penalty)
            for r, (i, scores, sizes) in enumerate(group):
                out[i] = self._answer(labels[r, : len(sizes)], scores, sizes)

    def _answer(self, own: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        langs = self.model.langs
        share = np.bincount(own, weights=sizes, minlength=len(langs))
        best = int(share.argmax())
        odds = np.exp(scores[own == best] / 4)
        sure = float((odds[:, best] / odds.sum(1)).mean())
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        return langs[best], float(share[best] / share.sum() * sure), [(int(a), int(b), langs[own[a]]) for a, b in zip(cut[:-1], cut[1:])]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, lang_pred, score (0 to 1), spans (array of first word, end word, lang).

    Null texts and texts without letters get ``und``, score 0 and no spans; so does everything if nothing was learned.
    Whole texts are labelled; repeated rows give repeated rows; no rows none; extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats, whatever the corpus
    name = f"langid {uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = held(name, lambda: Labeller(shared.value))
        for b in batches:
            got = labeller.label(list(b["text"]))
            trim()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "spans": [[{"first": a, "end": e, "lang": s} for a, e, s in x[2]] for x in got]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, spans array<struct<first: int, end: int, lang: string>>")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.0, clear_score: float | None = None) -> DataFrame:
    """Rows of ``docs`` whose text has a language (not ``und``) at ``least_score`` or more, with all their columns.

    A null ``lang`` takes the predicted language, and so does one that a score of ``clear_score`` or more contradicts;
    other languages stay as they are. If nothing was learned, all texts with letters are kept. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = f"langid {uuid.uuid4().hex}"

    def run(batches):
        import pyarrow as pa

        labeller = held(name, lambda: Labeller(shared.value))
        for b in batches:
            texts = b.column("text").to_pylist()
            got = labeller.label(texts)
            own = b.column("lang").to_pylist()
            lang = [x[0] if v is None or (clear_score is not None and x[0] != UND and x[1] >= clear_score) else v for v, x in zip(own, got)]
            b = b.set_column(b.schema.get_field_index("lang"), b.schema.field("lang"), pa.array(lang, b.schema.field("lang").type))
            if labeller.model.langs:
                kept = [x[0] != UND and x[1] >= least_score for x in got]
            else:
                kept = [t is not None and any(map(str.isalpha, t)) for t in texts]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
