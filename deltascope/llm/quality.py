"""Quality rules on tokeniser fertility, after plain counting rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held, trim
from .shingles import word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Band:
    """What a text of one language or script may show; outside of it, it is rejected."""

    chars_per_token: tuple[float, float]
    tokens_per_word: tuple[float, float]
    byte_share: float
    entropy_bits: float


#: Bands of the 32,000-piece vocabulary, by language, else by script, else "*". The lower ends leave about three in a
#: thousand labelled good documents outside (measured on the labels table).
BANDS = {
    "en": Band((2.00, 8.0), (1.0, 3.2), 0.05, 4.8),
    "fr": Band((1.84, 8.0), (1.0, 3.5), 0.05, 4.8),
    "de": Band((2.06, 8.0), (1.0, 3.5), 0.05, 4.8),
    "es": Band((1.79, 8.0), (1.0, 3.7), 0.05, 4.8),
    "latin": Band((1.70, 9.0), (1.0, 3.8), 0.10, 4.5),
    "cyrillic": Band((1.20, 9.0), (1.0, 7.0), 0.10, 4.0),
    # wide around a few sentences of ordinary prose each, since no corpus in these scripts was at hand
    "greek": Band((0.50, 4.0), (1.0, 14.0), 0.20, 3.0),
    "arabic": Band((0.50, 4.0), (1.0, 14.0), 0.20, 3.0),
    "hebrew": Band((0.50, 4.0), (1.0, 14.0), 0.20, 2.8),
    "devanagari": Band((0.40, 3.0), (1.0, 14.0), 0.40, 3.2),
    "hangul": Band((0.35, 2.5), (1.0, 14.0), 0.45, 3.2),
    "thai": Band((0.50, 4.0), (1.0, 1e9), 0.30, 3.0),
    "kana": Band((0.50, 2.5), (1.0, 1e9), 0.35, 3.5),
    "han": Band((0.40, 2.5), (1.0, 1e9), 0.45, 3.5),
    "*": Band((0.25, 9.0), (1.0, 1e9), 0.95, 3.0),
}
_SCRIPTS = tuple((name, re.compile(f"[{chars}]")) for name, chars in (("latin", "A-Za-zÀ-ɏ"), ("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽ"), ("arabic", "؀-ۿ"), ("hebrew", "֐-׿"), ("devanagari", "ऀ-ॿ"), ("hangul", "가-힣"), ("thai", "฀-๿"), ("kana", "぀-ヿ"), ("han", "㐀-鿿")))
_LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """A public piece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    @classmethod
    def get(cls, path: str) -> "Pieces":
        return held(f"pieces {path}", lambda: cls(path))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def repeated_words(words: np.ndarray) -> int:
    """Words (as hashes) that lie in a 3-word window found twice or more."""
    if len(words) < 3:
        return 0
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    windows = (words[:-2] * a) ^ (words[1:-1] * b) ^ (words[2:] * c)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(words), bool)
    for k in range(3):
        mark[k : k + len(twice)] |= twice
    return int(mark.sum())


def fertility(ids: np.ndarray, chars: int, words: int, is_byte: np.ndarray) -> tuple[float, float, float, float]:
    """Characters per token, tokens per word, byte-fallback share, entropy of the tokens in bits."""
    if not len(ids) or not words:
        return 0.0, 0.0, 0.0, 0.0
    count = np.unique(ids, return_counts=True)[1] / len(ids)
    return chars / len(ids), len(ids) / words, float(is_byte[ids].mean()), float(-(count * np.log2(count)).sum())


def band_of(lang: str | None, text: str, bands: dict[str, Band] = BANDS) -> str:
    """The name of the band: the language's if it has one, else the script's of most letters, else "*"."""
    if lang in bands:
        return lang
    letters = len(_LETTER.findall(text))
    for name, pattern in _SCRIPTS:
        if name in bands and letters and 2 * len(pattern.findall(text)) > letters:
            return name
    return "*"


def _measured(b: pd.DataFrame, pieces: Pieces, lot: int = 1_000_000) -> Iterator[tuple]:
    """(doc_id, text, lang, word hashes, ids) of each row, worked out about ``lot`` characters at a time."""
    texts = [t or "" for t in b["text"]]
    sizes, a = np.cumsum([len(t) for t in texts]), 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + lot, side="right")))
        own = texts[a:z]
        yield from zip(b["doc_id"].iloc[a:z], own, b["lang"].iloc[a:z], word_hashes(own), pieces.ids(own))
        a = z


def judge(docs: DataFrame, vocabulary: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text, lang): counts, fertility and verdict over the whole text.

    Null and empty texts have no words, fail the base rules and are not kept; their fertility is 0. A null or unknown
    language falls back to the script. Repeated rows give repeated rows, no rows none; extra columns are ignored.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.get(vocabulary)
        for b in batches:
            rows = []
            for d, t, lang, words, ids in _measured(b, pieces):
                n, again, chars = len(words), repeated_words(words), len(t) - sum(map(t.count, SPACES))
                earlier, dup = set(), 0
                for line in t.split("\n"):
                    if line in earlier:
                        dup += 1
                    elif line.strip(SPACES):
                        earlier.add(line)
                failed = n < 50 or 100 * again > 50 * n
                name = band_of(lang, t, bands)
                per_token, per_word, share, bits = fertility(ids, chars, n, pieces.is_byte)
                band = bands[name]
                fits = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and band.tokens_per_word[0] <= per_word <= band.tokens_per_word[1] and share <= band.byte_share and bits >= band.entropy_bits
                rows.append((d, n, chars, sum(map(t.count, SYMBOLS)), dup, again, failed, bool(fits and not failed), name, per_token, per_word, share, bits))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", "chars_per_token", "tokens_per_word", "byte_share", "entropy_bits"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            trim()
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInPandas(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, band string, chars_per_token double, tokens_per_word double, byte_share double, entropy_bits double")
