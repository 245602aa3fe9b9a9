"""Alignment of two versions' paragraphs: best word overlap, greedy TF-IDF cosine, and differences by common blocks."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import diff, overlap


def section_change(pairs: DataFrame, old: str = "old_text", new: str = "new_text", unchanged: float = 0.8, modified: float = 0.5) -> DataFrame:
    """Paragraph changes of each pair: counts and change ratio, all within the pair's row."""

    @F.pandas_udf("struct<paragraphs: long, added: long, modified: long, removed: long>")
    def run(cur: pd.Series, prev: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(cur, prev):
            s, r = overlap.best_overlaps(*[[overlap.wording(p) for p in x] if x is not None else [] for x in (a, b)])
            out.append((len(s), (s < modified).sum(), ((s >= modified) & (s < unchanged)).sum(), (r < modified).sum()))
        return pd.DataFrame(out, columns=["paragraphs", "added", "modified", "removed"], dtype="int64")

    out = pairs.withColumn("_x", run(T.paragraphs(F.lower(new)), T.paragraphs(F.lower(old))))
    out = out.select(*pairs.columns, *[F.when(F.col(old if c == "removed" else new).isNotNull(), F.col(f"_x.{c}")).alias(c) for c in ("paragraphs", "added", "modified", "removed")])
    total = F.col("paragraphs") + F.col("removed")
    return out.withColumn("change_ratio", F.when(total > 0, F.round((F.col("added") + F.col("modified") + F.col("removed")) / total, 3)).otherwise(0.0))


def _vectors(docs: list[list[str]]) -> list[dict[str, float]]:
    n, df = len(docs), Counter(t for d in docs for t in set(d))
    return [{t: c / len(d) * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(d).items()} for d in docs]


def greedy_pairs(new: list[str], old: list[str], unchanged: float = 0.95, match: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(change, new index or -1, old index or -1, cosine): best pairs first, larger indices first on ties."""
    vectors = _vectors([re.findall("[a-z]+", p.lower()) for p in [*new, *old]])
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    posts: dict[str, list[int]] = {}
    for j in range(len(old)):
        for t in vectors[len(new) + j]:
            posts.setdefault(t, []).append(j)
    scored = []
    for i in range(len(new)):
        dots: Counter = Counter()
        for t, x in vectors[i].items():
            for j in posts.get(t, ()):
                dots[j] += x * vectors[len(new) + j][t]
        scored += [(d / (norms[i] * norms[len(new) + j]), i, j) for j, d in dots.items()]
    used_new, used_old, out = set(), set(), []
    for s, i, j in sorted((x for x in scored if x[0] >= match), reverse=True):
        if i not in used_new and j not in used_old:
            used_new.add(i)
            used_old.add(j)
            out.append(("unchanged" if s >= unchanged else "revised", i, j, s))
    return out + [("added", i, -1, 0.0) for i in range(len(new)) if i not in used_new] + [("removed", -1, j, 0.0) for j in range(len(old)) if j not in used_old]


def opcode_pairs(new: list[str], old: list[str], unchanged: float = 0.95, revised: float = 0.6) -> list[tuple[str, int, int, float]]:
    """Alignment by the spans of both lists; what a replacement has over on one side is added or removed."""
    out = []
    for tag, a, b, c, d in diff.spans(old, new):
        if tag == "equal":
            out += [("unchanged", c + k, a + k, 1.0) for k in range(b - a)]
            continue
        for k in range(max(b - a, d - c)):
            i, j = (c + k if c + k < d else -1), (a + k if a + k < b else -1)
            if i < 0 or j < 0:
                out.append(("removed" if i < 0 else "added", i, j, 0.0))
            else:
                ratio = char_ratio(old[j], new[i])
                out.append(("unchanged" if ratio >= unchanged else "revised", i, j, ratio))
    return out


def char_ratio(a: str, b: str) -> float:
    return diff.ratio(a, b)


def new_sentences(old: list[str], new: list[str], below: float = 0.75, most: int = 20) -> list[str]:
    """Sentences of ``new`` unlike every one of ``old``; lengths and letters alone rule most comparisons out."""
    out, known = [], set(old)
    alike = lambda o, s: 2 * min(len(s), len(o)) >= below * (len(s) + len(o)) and diff.ratio_bound(o, s) >= below and char_ratio(o, s) >= below
    for s in new:
        if not (s in known and below <= 1) and not any(alike(o, s) for o in old):
            out.append(s)
        if len(out) == most:
            break
    return out


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """(tag, text) spans: equal, added, removed."""
    a, b, out = old.split(), new.split(), []
    for tag, i, j, k, m in diff.spans(a, b):
        if tag == "equal":
            out.append(("equal", " ".join(a[i:j])))
        else:
            out += [(t, " ".join(x)) for t, x in (("removed", a[i:j]), ("added", b[k:m])) if x]
    return out


def aligner(method):
    """A vectorised function over (new paragraphs, old paragraphs) that gives array<struct<change,new,old,score>>."""

    @F.pandas_udf("array<struct<change: string, new_at: int, old_at: int, score: double>>")
    def run(new: pd.Series, old: pd.Series) -> pd.Series:
        return pd.Series([[{"change": c, "new_at": i, "old_at": j, "score": s} for c, i, j, s in method(list(a), list(b))] if a is not None and b is not None else None for a, b in zip(new, old)])

    return run


def text_ratio():
    """Vectorised character ratio of whole texts."""

    @F.pandas_udf("double")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else char_ratio(a, b) for a, b in zip(old, new)])

    return run


def word_spans():
    """Vectorised word diff: array<struct<tag, text>>."""

    @F.pandas_udf("array<struct<tag: string, text: string>>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else [{"tag": t, "text": x} for t, x in word_diff(a, b)] for a, b in zip(old, new)])

    return run


def novelty(below: float = 0.75, most: int = 20):
    """Vectorised :func:`new_sentences` over arrays of old and new sentences."""

    @F.pandas_udf("array<string>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([new_sentences(list(a), list(b), below, most) if a is not None and b is not None else None for a, b in zip(old, new)])

    return run
