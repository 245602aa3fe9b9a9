"""Corpus pipeline over ``documents``: language ID, n-gram Jaccard join, PII, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, whatever further columns there are and whatever they are called; the last returns one row a packed piece.
Null and empty texts go in the first stage; later stages take them as texts without words, entities or tokens of their
own. Null doc_ids and sources are kept, a null source is one of its own. Texts of any length are worked on whole. No rows
give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import jaccard, langid, mixing, packing, pii
from deltascope.llm.common import materialize, maybe_broadcast, table

#: Near-duplicates of the pipeline: five words, a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: A text needs LEAST_SCORE to count as one of a language: all 3,409 identified documents of sf0.1 labelled good reach it
#: (the least has 0.47). A stated language gives way to another one at CLEAR_SCORE or more: 2 of 10,000 documents there.
LEAST_SCORE, CLEAR_SCORE = 0.4, 0.75
PII_KEY = "deltascope"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; null texts and those without letters or a sufficient score go. A null or clearly
    contradicted lang takes the predicted one. Repeated rows fare alike."""
    return langid.keep_identified(docs, langid.train(docs), LEAST_SCORE, CLEAR_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked documents. Rows that repeat doc_id and text are one
    document too. Rows without doc_id stay; of other rows that repeat a doc_id all stay or none."""
    found = jaccard.jaccard_components(docs, WORDS, PERCENT)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    kept = docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"] == gone["_gone"], "left_anti")
    often = materialize(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_often")).count().where("count > 1").select("_often"))
    n = often.count()
    again = kept["doc_id"] == often["_often"]
    once = kept.join(maybe_broadcast(often, n), again, "left_anti")
    # partial aggregates, so that no repeated document is gathered
    row = F.struct(*[F.col(c) for c in docs.columns])
    more = kept.join(maybe_broadcast(often, n), again, "left_semi").groupBy(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return once.unionByName(more)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text, null for a null text."""
    out = pii.anonymize(docs, PII_KEY, count=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it; rows that repeat a doc_id are rows of their own."""
    return mixing.take(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in as few sequences as found; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), lean=True)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing to target weights", mixture), ("best-fit packing", packed)]

#: SQL can express neither Viterbi labels nor the entropy-balanced copies nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
