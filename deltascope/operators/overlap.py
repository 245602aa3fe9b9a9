"""What the paragraphs of two versions of one text have in common, within the row that holds both.

Spark joins the versions and gives each row to a task; the work in a row follows its own words, in blocks of bounded size, and
what leaves it are numbers, never words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Products held at a time; rows given on at a time.
CELLS, LOT = 1 << 20, 10_000
_WORD, _MASKED, _NUMBER = re.compile("[a-z]+"), re.compile("[a-z#]+"), re.compile("[0-9]+")


def incidence(bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, term, times) of each term of each bag, in order of bags; terms are numbered."""
    names: dict[str, int] = {}
    terms = np.array([names.setdefault(t, len(names)) for b in bags for t in b], np.int64)
    place = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    both, times = np.unique(place * max(len(names), 1) + terms, return_counts=True)
    return both // max(len(names), 1), both % max(len(names), 1), times


def products(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_new: int, n_old: int, cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """(i, block) of the inner products of the vectors 0 to ``n_new`` with the ``n_old`` after them: row k of a block belongs to
    vector i + k. Vectors meet through their common terms; a block and the products for it stay near ``cells`` (one vector at least)."""
    cut = int(np.searchsorted(rows, n_new))
    order = cut + np.argsort(terms[cut:], kind="stable")
    old, weight, posted = rows[order] - n_new, values[order], np.bincount(terms[cut:], minlength=int(terms.max(initial=0)) + 1)
    first, many = np.cumsum(posted) - posted, posted[terms[:cut]]
    from_row = np.searchsorted(rows[:cut], np.arange(n_new + 1))
    work = np.concatenate([[0], np.cumsum(many)])[from_row] + n_old * np.arange(n_new + 1)
    i = 0
    while i < n_new:
        end = max(i + 1, int(np.searchsorted(work, work[i] + cells, "right")) - 1)
        a, b = from_row[i], from_row[end]
        times = many[a:b]
        entry = np.repeat(np.arange(a, b), times)
        at = np.arange(len(entry)) + np.repeat(first[terms[a:b]] - (np.cumsum(times) - times), times)
        sums = np.bincount((rows[entry] - i) * n_old + old[at], weights=values[entry] * weight[at], minlength=(end - i) * n_old)
        yield i, sums.reshape(end - i, n_old)
        i = end


def cosines(new: list[list[str]], old: list[list[str]], least: float, copies: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of all bags of ``new`` and ``old`` with a TF-IDF cosine of ``least`` or more, a block at a time. A bag stands for
    ``copies`` equal paragraphs (one), which all together are the corpus."""
    bags = [*new, *old]
    n = np.ones(len(bags)) if copies is None else np.asarray(copies, float)
    place, term, times = incidence(bags)
    if not len(place):
        return
    df = np.bincount(term, weights=n[place])
    w = times / np.array([len(b) for b in bags])[place] * (np.log((n.sum() + 1) / (df[term] + 1)) + 1)
    norm = np.sqrt(np.bincount(place, weights=w * w, minlength=len(bags)))
    norm[norm == 0] = 1.0
    for i, dots in products(place, term, w, len(new), len(old)):
        dots = dots / (norm[i : i + len(dots), None] * norm[None, len(new) :])
        a, b = np.nonzero(dots >= least)
        yield a + i, b, dots[a, b]


def wording(paragraph: str) -> list[str]:
    """The word set of a lower-case paragraph with numbers masked, so that new figures alone are no change."""
    return list(dict.fromkeys(_MASKED.findall(_NUMBER.sub("#", paragraph))))


def best_overlaps(new: list[list[str]], old: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Highest Jaccard of each word set with any of the other side: of ``new`` and of ``old``; 0 if there is none, 1 for two empty sets.
    Sets that are alike are compared once."""
    sides = [list(dict.fromkeys(map(frozenset, x))) for x in (new, old)]
    a, b = ([list(x) for x in side] for side in sides)
    size = np.array([len(x) for x in (*a, *b)], np.int64)
    best_new, best_old = np.zeros(len(a)), np.zeros(len(b))
    if a and b:
        for i, both in products(*incidence([*a, *b]), len(a), len(b)):
            union = size[i : i + len(both), None] + size[None, len(a) :] - both
            share = np.where(union == 0, 1.0, both / np.maximum(union, 1))
            best_new[i : i + len(both)] = share.max(axis=1)
            np.maximum(best_old, share.max(axis=0), out=best_old)
    out = []
    for own, side, best in ((new, sides[0], best_new), (old, sides[1], best_old)):
        place = {x: k for k, x in enumerate(side)}
        out.append(best[np.array([place[frozenset(x)] for x in own], np.int64)])
    return out[0], out[1]


def _rows(own: DataFrame, schema: str, of_row) -> DataFrame:
    """``of_row`` (new, old) gives lists of columns for each row of ``own`` (key, new, old: lower-case paragraphs); null is no paragraph.
    The rows made go on in lots."""
    kind = own.schema["key"].dataType.simpleString()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                words = [[_WORD.findall(p or "") for p in batch.column(c)[k].as_py() or []] for c in (1, 2)]
                for columns in of_row(*words):
                    n = len(columns[0])
                    if n:
                        key = batch.column(0).take(pa.array(np.full(n, k)))
                        held.append(pa.RecordBatch.from_arrays([key, *map(pa.array, columns)], names))
                        size += n
                    if size > LOT:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    names = ["key", *[x.split()[0] for x in schema.split(", ")]]
    return own.select("key", "new", "old").mapInArrow(run, f"key {kind}, {schema}")


def cosine_pairs(own: DataFrame, least: float) -> DataFrame:
    """(key, new_at, old_at, cosine) of the paragraph pairs of each row of ``own`` (key, new, old) with a cosine of ``least`` or more;
    a row's paragraphs are the corpus of its term weights."""
    return _rows(own, "new_at long, old_at long, cosine double", lambda new, old: cosines(new, old, least))


def bag_pairs(own: DataFrame, least: float) -> DataFrame:
    """Paragraphs and pairs of each row of ``own`` (key, new, old) as (key, kind, a, b, n, m, s).

    Paragraphs with the same words are one bag, named by its last place. Kinds n and o: place a lies in bag b (-1 if it has no
    word) as the n-th from its end, m is 0. Kind p: bags a (new, of n paragraphs) and b (old, of m) have cosine s, ``least`` or more."""

    def of_row(*sides):
        bags: list[dict[str, list[int]]] = []
        for kind, words in zip("no", sides):
            own: dict[str, list[int]] = {}
            for at in reversed(range(len(words))):
                own.setdefault(" ".join(sorted(words[at])), []).append(at)
            members = [(at, places[0] if word else -1, k) for word, places in own.items() for k, at in enumerate(places, 1)]
            if members:
                yield [kind] * len(members), *map(list, zip(*members)), [0] * len(members), [0.0] * len(members)
            own.pop("", None)
            bags.append(own)
        place, size = ([np.array([p[0] for p in b.values()], np.int64) for b in bags], [np.array([len(p) for p in b.values()], np.int64) for b in bags])
        new, old = ([b.split(" ") for b in side] for side in bags)
        for i, j, s in cosines(new, old, least, np.concatenate(size).tolist()):
            yield ["p"] * len(i), place[0][i], place[1][j], size[0][i], size[1][j], s

    return _rows(own, "kind string, a long, b long, n long, m long, s double", of_row)
