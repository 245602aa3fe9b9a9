"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MULS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_VALUES = np.random.default_rng(20240517).integers(1, 2**64, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z read as a-z
_CASED = np.random.default_rng(20240518).integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64)))]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _words(raw: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each text's words begin and end."""
    text = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    power, inverse = _powers_of(len(text))
    space = _SPACE[text]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[text] * power[: len(text)])])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.array([len(x) + 1 for x in raw])
    return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))


def _chunk(raw: list[bytes], k: int) -> list[np.ndarray]:
    words, cut = _words(raw, _VALUES)

    def fold(parts: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(parts[0]), np.uint64)
        for i, w in enumerate(parts):
            h = _mix((h ^ w) * _MULS[i % len(_MULS)] + np.uint64(i))
        return h

    runs = fold([words[i : len(words) - k + 1 + i] for i in range(k)]) if len(words) >= k else words[:0]
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(fold([words[i : i + 1] for i in range(a, b)]))
        else:
            out.append(words[:0])
    return out


def _cased(raw: list[bytes]) -> list[np.ndarray]:
    words, cut = _words(raw, _CASED)
    return [words[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _in_chunks(texts: list[str | None], run, chunk_bytes: int) -> list[np.ndarray]:
    out, held, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > chunk_bytes:
            out += run(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    return out + (run(held) if held else [])


def word_hashes(texts: list[str | None], chunk_bytes: int = 1 << 18) -> list[np.ndarray]:
    """64-bit hashes of each text's words in order, capitals told apart. Null: none."""
    return _in_chunks(texts, _cased, chunk_bytes)


def shingle_sets(texts: list[str | None], k: int, chunk_bytes: int = 1 << 18) -> list[np.ndarray]:
    """The distinct ``k``-word shingles of each whole text; fewer words make one shingle; no word, none. Null: none."""
    return _in_chunks(texts, lambda raw: _chunk(raw, k), chunk_bytes)
