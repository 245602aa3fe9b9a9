"""Text measures as column expressions, built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(x: Column) -> Column:
    """Maximal runs of non-space characters; none for empty text."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def tokens(x: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))


def paragraphs(x: Column, least_words: int = 15) -> Column:
    """Lines of at least ``least_words`` words, white space collapsed."""
    # lines too short to hold so many words are not looked at; of the others, the spaces are counted and no words made
    lines = F.transform(F.filter(F.split(x, "\n"), lambda p: F.length(p) >= 2 * least_words - 1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(lines, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) >= least_words - 1)


def merged_paragraphs(x: Column, least_words: int = 15, between: str = r"\n\s*\n") -> Column:
    """Paragraphs split at blank lines (or at ``between``); short ones run into the next until they have ``least_words`` words."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        text = F.trim(F.concat(acc["open"], F.lit(" "), F.trim(F.regexp_replace(p, r"\s+", " "))))
        full = F.size(words(text)) >= least_words
        return F.struct(F.when(full, F.array_append(acc["done"], text)).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(text).alias("open"))

    return F.aggregate(F.split(x, between), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def sentences(x: Column, longer_than: int = 20) -> Column:
    # no bare F.trim: it takes two columns, so that transform would hand it the place as the signs to trim
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def wording(x: Column) -> Column:
    """Word set of a paragraph with numbers masked, so that new figures alone are no change."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(x), "[0-9]+", "#"), F.lit("[a-z#]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_ratio(a: Column, b: Column) -> Column:
    """Share of the joint word set that only one side has; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def occurrences(x: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_density(x: Column, weights: Mapping[str, float], scale: float = 10.0) -> Column:
    total = F.lit(0.0)
    for word, weight in weights.items():
        total = total + weight * occurrences(F.lower(x), word)
    return F.least(total / scale, F.lit(1.0))


def keywords_found(x: Column, keys: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(x), F.lit(k)), F.lit(k)) for k in keys]))


def sentiment(toks: Column, positive: Sequence[str], negative: Sequence[str], negators: Sequence[str], reach: int = 3) -> Column:
    """Lexicon sentiment in [-1, 1]; a negator among the ``reach`` tokens before turns a word round."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])

    def value(t, i):
        before = F.slice(toks, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)))
        sign = F.when(F.arrays_overlap(before, lit(negators)), -1.0).otherwise(1.0)
        return sign * F.when(F.array_contains(lit(positive), t), 1.0).when(F.array_contains(lit(negative), t), -1.0).otherwise(0.0)

    total = F.aggregate(F.transform(toks, value), F.lit(0.0), lambda a, v: a + v)
    return F.tanh(total / F.greatest(F.lit(1.0), F.size(toks) / 50.0))


def numbers(x: Column) -> Column:
    """Distinct figures in canonical form: thousands separators dropped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "")))


def first_difference(a: Column, b: Column, lead: int = 6) -> tuple[Column, Column]:
    """Both word arrays from ``lead`` words before their first difference, if that lies deeper than twice ``lead``."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    at = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    start = F.when(at > 2 * lead, at - lead).otherwise(0)
    mark = F.when(start > 0, "...").otherwise("")
    cut = lambda w: F.concat(mark, F.array_join(F.slice(w, (start + 1).cast("int"), F.greatest(F.size(w), F.lit(1))), " "))
    return cut(a), cut(b)


def clip(x: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a word boundary with an ellipsis."""
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n - 3), r" [^ ]*$", ""), F.lit("...")))


def fingerprint(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)
