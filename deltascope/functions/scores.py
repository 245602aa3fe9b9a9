"""Scores and ranks as column expressions; every weight and threshold is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def steps(x: Column, levels: Sequence[tuple[float, object]], rest: object) -> Column:
    """The value of the first level that ``x`` reaches, from the highest down."""
    (bound, value), *others = levels
    out = F.when(x >= bound, F.lit(value))
    for bound, value in others:
        out = out.when(x >= bound, F.lit(value))
    return out.otherwise(F.lit(rest))


NAMES = ((80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW"))


def rank_name(score: Column, rest: str = "NOISE") -> Column:
    return steps(score, NAMES, rest)


def attention_gap(materiality: Column, coverage: Column, floor: float = 0.01) -> Column:
    return materiality / F.greatest(coverage, F.lit(floor))


def alert_rank(materiality: Column, burial: Column, gap: Column) -> Column:
    """1 to 5 from the weighted blend of materiality, burial and the gap capped at 100."""
    blend = 0.5 * materiality + 0.3 * burial + 0.2 * F.least(gap, F.lit(100.0))
    return steps(blend, ((80, 5), (60, 4), (40, 3), (20, 2)), 1)


def unified_score(materiality: Column, quality: Column, articles: Column, count_weight: float = 0.35, quality_weight: float = 0.65) -> dict[str, Column]:
    """Composite news, gap, final score (0-100), rank and confidence of one entity."""
    m, q, n = clamp(materiality), clamp(quality), F.greatest(articles, F.lit(0))
    volume = F.least(n / 20.0, F.lit(1.0))
    composite = count_weight * volume + quality_weight * q
    gap = attention_gap(m, composite)
    final = clamp(F.least(gap * 100.0, F.lit(100.0)) + F.when(n < 5, 10.0).otherwise(0.0) - F.when(m < 0.2, 15.0).otherwise(0.0), 0.0, 100.0)
    return {"composite": composite, "gap": gap, "score": F.round(final, 2), "rank": rank_name(final), "confidence": F.round(clamp(F.sqrt(volume) * m), 4)}


def coverage_step(articles: Column) -> Column:
    """Normalised coverage from an article count."""
    return F.when(articles <= 0, 0.05).when(articles <= 2, 0.15).when(articles <= 5, 0.35).when(articles <= 10, 0.60).when(articles <= 20, 0.80).otherwise(1.0)


def item_materiality(words_new: Column, words_old: Column, similarity: Column, hedge: Column) -> Column:
    """0-1 from the word change, the dissimilarity and the hedging shift of one item."""
    change = F.abs(words_new - words_old) / F.greatest(words_old, F.lit(1))
    return clamp(0.5 * change + 0.3 * (1 - similarity) + 0.2 * F.abs(hedge))


def section_score(changed: Column, total: Column, hedge: Column, specifics: Column, old: Column, weight: Column) -> Column:
    """0-100 from volume, hedging and specificity shifts of a section, times its weight."""
    volume = F.when(total > 0, F.least(changed / total * 100, F.lit(100.0))).otherwise(0.0)
    base = F.greatest(old, F.lit(1))
    return F.least((0.5 * volume + 0.3 * F.greatest(hedge / base * 100, F.lit(0.0)) + 0.2 * F.greatest(specifics / base * 50, F.lit(0.0))) * weight, F.lit(100.0))


def burial_score(filed: Column, position: Column, obscurity: Column, boilerplate: Column) -> Column:
    """0-100: late position, obscure section, boilerplate and end-of-week filing (Fri 20; Thu, Sat, Sun 10)."""
    day = F.weekday(filed)
    return F.least(30 * position + 25 * obscurity + 15 * boilerplate + F.coalesce(F.when(day == 4, 20).when(day >= 3, 10), F.lit(0)), F.lit(100.0))


def combined_gap(materiality: Column, coverage: Column, impact: Column, w_coverage: float = 0.7, w_price: float = 0.3) -> Column:
    return materiality / F.greatest(w_coverage * F.greatest(coverage, F.lit(0.01)) + w_price * impact / 100.0, F.lit(0.01))


def price_impact(abnormal: Column, volume_ratio: Column) -> Column:
    return F.when(abnormal.isNull(), 50.0).otherwise(F.least(F.least(1000 * F.abs(abnormal), F.lit(100.0)) + clamp(10 * (F.coalesce(volume_ratio, F.lit(1.0)) - 1), 0.0, 30.0), F.lit(100.0)))


def article_quality(raw: Column, n: Column, heaviest: Column) -> Column:
    """Logistic of the negated mean weight (bearish news high)."""
    return F.when((n == 0) | (heaviest == 0), 0.5).otherwise(1 / (1 + F.exp(3 * raw / (n * heaviest))))


def headline_quality(raw: Column, n: Column) -> Column:
    """Logistic of the mean weight (bullish news high)."""
    return F.when(n == 0, 0.5).otherwise(1 / (1 + F.exp(-3 * raw / (n * 0.72))))


def feed_composite(n: Column, mean_quality: Column) -> Column:
    return 0.35 * clamp(F.log1p(n) / F.log1p(F.lit(20.0)), 0.05, 1.0) + 0.65 * F.coalesce(mean_quality, F.lit(0.5))


def recency(age_hours: Column, half_life: float = 6.0, most: float = 72.0) -> Column:
    return F.coalesce(F.pow(F.lit(2.0), -clamp(age_hours, 0.0, most) / half_life), F.lit(0.5))


def risk_signal(base: Column, hits: Column) -> Column:
    return F.least(base * F.log1p(hits), F.lit(1.0))


def trend_label(slope: Column, threshold: float = 0.5) -> Column:
    return F.when(slope > threshold, "RISING").when(slope < -threshold, "FALLING").otherwise("STABLE")
