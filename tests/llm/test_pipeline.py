"""The corpus pipeline: each stage and the whole on nulls, empty and very long texts, repeats, clashing columns, no rows."""

import collections
import os

import pytest

import corpus_pipeline
from deltascope.llm import jaccard

KIND = ("doc_id long, text string, lang string, source string, n_chars long, copies int, n_entities string, _map string, _row string, size string, rate double, component_id long, _k int, "
        "_rank int, score double, _h string, row_hash string, _gone string, _often string, _d string, _t string, _id long, _c0 string, count string")
EN, DE = "the cat and the dog were in the house of that man", "der hund und die katze sind nicht in dem haus"


def rows():
    base = [(EN + f" number{i} " + " ".join(f"word{(i * 7 + k) % 50}" for k in range(i % 40 + 5)), "en") if i % 2 else (DE + f" zahl{i} " + " ".join(f"wort{(i * 11 + k) % 60}" for k in range(i % 30 + 5)), "de") for i in range(40)]
    texts = [(i, t, lang, ("a", "b", None)[i % 3]) for i, (t, lang) in enumerate(base)]
    long = " ".join(f"{EN} part{i}" for i in range(20_000))  # over 1 MB
    texts += [(100, None, "en", "a"), (101, "", None, "b"), (102, long, None, "a"), (103, "Mail bob.smith@mail.example.com or Bob, token: 密码密码密码密码 " + EN, "en", "a"), (None, "the house of that man and the dog " + EN, "en", "b"), (None, None, None, None)]
    texts += [texts[3]] * 4 + [(7, "another text of the man in the house " + EN, "en", "a"), (104, base[5][0], "en", "b"), (105, "12345 !!", "en", "a")]
    return [(*t, None if t[1] is None else len(t[1]), 9, "e", "m", "r", "s", 0.5, 3, 1, 2, 0.1, "h", "rh", "g", "o", "d", "t", 4, "c", "n") for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages_keep_columns_and_rows(spark, docs):
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, "")
        assert out.columns == docs.columns, name
        own = spark.createDataFrame(out.collect(), docs.schema)
        assert all((r.copies, r.n_entities, r["_map"], r["size"], r["_c0"], r["count"]) == (9, "e", "m", "s", "c", "n") for r in own.collect()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, own, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in own.collect()} and max(r.piece for r in pieces if r.doc_id == 102) > 100
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_language_keeps_lettered_texts(spark, docs):
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert {r.doc_id for r in kept} >= set(range(40)) | {102, 103} and {100, 101, 105}.isdisjoint({r.doc_id for r in kept})
    assert next(r.lang for r in kept if r.doc_id == 102) == "en"


def test_near_duplicates_one_of_each_group(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    count = collections.Counter((r.doc_id, r.text) for r in kept)
    assert max(count.values()) == 1  # rows that repeat doc_id and text are one document
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, corpus_pipeline.WORDS, corpus_pipeline.PERCENT).collect() if r.doc_id is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(groups.values()) and sum(r.doc_id is None for r in kept) == 2


def test_mixture_takes_the_planned_copies(spark, docs):
    from deltascope.llm import mixing

    plan, out = mixing.mix(docs).collect(), corpus_pipeline.mixture(spark, docs, "").collect()
    want, got = collections.Counter(), collections.Counter(r.doc_id for r in out)
    for r in plan:
        want[r.doc_id] += r.copies
    assert +want == got and len(plan) == docs.count()
    # a hot group of like rows is taken row by row
    hot = spark.createDataFrame([(1, EN, "en", "a", 1)] * 700 + [(2 + i, EN + f" {i}", "en", "b", 1) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(hot)
    assert corpus_pipeline.mixture(spark, hot, "").where("doc_id = 1").count() == sum(r.copies for r in plan.where("doc_id = 1").collect())
    assert len({r.copies for r in plan.where("doc_id = 1").collect()}) == 2


def test_whole_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert os.path.exists(tmp_path / "none")
