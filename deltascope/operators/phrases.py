"""Many phrases in many texts: phrases are a table, matching is a join on their first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """The lower-case words of a text, letters only; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def find_phrases(texts: DataFrame, phrases: DataFrame, key: str, most_bytes: int = 32 << 20) -> DataFrame:
    """(key, category, phrase, weight, at) of every place (word number from 1) of ``texts`` (key, text) where a phrase of
    ``phrases`` (category, phrase, weight) begins.

    Texts and phrases are compared as lower-case words, whatever stands between them. Each word is looked up among the first
    words of all phrases, together with the word behind it if no phrase is shorter; the rest is compared only where these agree. The phrases go to all executors
    if their measured size allows, else words and phrases meet in a shuffle. Phrases without words and null texts match
    nothing; a phrase that stands twice in a category counts once, with its largest weight.
    """
    table = phrases.select("category", F.array_join(words_of(F.col("phrase")), " ").alias("phrase"), "weight").where("phrase <> ''")
    table = table.groupBy("category", "phrase").agg(F.max("weight").alias("weight"))
    n = F.size(F.split("phrase", " "))
    size, longest, shortest = table.agg(F.sum(2 * F.length("phrase") + 64), F.max(n), F.min(n)).first()
    if size is not None and size <= most_bytes:
        table = F.broadcast(table)
    longest, lead = longest or 1, min(shortest or 1, 2)
    table = table.select("category", "phrase", "weight", *[F.element_at(F.split("phrase", " "), k + 1).alias(f"p{k}") for k in range(lead)])
    own = texts.select(key, words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    # the words beside themselves, moved by one, two and so on: no word list within a lambda, which would be made anew for each word
    moved = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(longest)]
    places = own.select(key, F.posexplode(F.arrays_zip(*moved)).alias("at", "z")).select(key, (F.col("at") + 1).alias("at"), "z.*")
    met = F.lit(True)
    for k in range(lead):
        met = met & (F.col(f"w{k}") == F.col(f"p{k}"))
    # the words behind are put together only where the first ones of a phrase were met
    run = F.concat_ws(" ", *[F.col(f"w{k}") for k in range(longest)])
    whole = F.startswith(F.concat(run, F.lit(" ")), F.concat("phrase", F.lit(" ")))
    return places.join(table, met).where(whole).select(key, "category", "phrase", "weight", "at")


def category_hits(texts: DataFrame, found: DataFrame, key: str, excerpts: int = 3, before: int = 50, after: int = 200) -> DataFrame:
    """(key, category, hits, weight, excerpts) of ``found``: how often a category's phrases stand in a text, the largest weight, and
    the surroundings of the first places in reading order, ``before`` characters before them to ``after`` from their start."""
    w = Window.partitionBy(key, "category").orderBy("at", "phrase")
    ranked = found.withColumn("k", F.row_number().over(w))
    own = ranked.groupBy(key, "category").agg(F.count("*").alias("hits"), F.max("weight").alias("weight"), F.sort_array(F.collect_list(F.when(F.col("k") <= excerpts, F.struct("k", "at")))).alias("places"))
    prose = F.col("prose")
    at = lambda p: F.length(F.call_function("substring_index", prose, F.lit(" "), p["at"] - 1)) + F.when(p["at"] > 1, 2).otherwise(1)
    start = lambda p: F.greatest(F.lit(1), at(p) - before)
    cut = lambda p: F.substring(prose, start(p), at(p) + after - start(p))
    # a text is tidied once, before the join, and meets one row with all its categories
    tidy = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))
    by_text = own.groupBy(key).agg(F.collect_list(F.struct("category", "hits", "weight", "places")).alias("c"))
    out = by_text.join(texts.select(key, tidy.alias("prose")), key)
    return out.select(key, F.inline(F.transform("c", lambda c: F.struct(c["category"].alias("category"), c["hits"].alias("hits"), c["weight"].alias("weight"), F.transform(c["places"], cut).alias("excerpts")))))
