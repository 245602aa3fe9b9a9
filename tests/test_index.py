"""The keyword index against a scan, and the bytes that it spares."""

import os
import random
import tempfile

from deltascope.operators import index


def test_same_rows_as_a_scan(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcDE") for _ in range(rng.randrange(1, 5)))
    rows = [(i, "".join(word() + rng.choice([" ", "  ", "\n", ".", "\t"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(500, None), (None, "abc de"), (501, ""), (7, "abc de")]
    texts = spark.createDataFrame(rows, "id long, text string")
    path = tempfile.mkdtemp(prefix="index-")
    index.write_index(texts, "id", path, buckets=8, lot=50)
    for keyword in ("a", "abc", "E", "c d", " abc", "de ", "a b", "abc de", "zz", "B\tC", " ", "", "a  b", " d ", "cde\na"):
        want = {i for i, t in rows if i is not None and t is not None and keyword.lower() in t.lower()}
        got = [r.key for r in index.containing(texts, "id", path, keyword).collect()]
        assert set(got) == want and len(got) == len(want), keyword


def test_rare_words_read_few_folders(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " common") for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, text string")
    path = tempfile.mkdtemp(prefix="index-")
    index.write_index(texts, "id", path, buckets=32)
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    every = size(spark.read.parquet(f"{path}/postings").inputFiles())
    assert [r.key for r in index.containing(texts, "id", path, "w77x5 ").collect()] == [77]
    words = spark.read.parquet(f"{path}/words").where("chunk = 'w77x59'").select("bucket").first()[0]
    assert size(spark.read.parquet(f"{path}/postings").where(f"bucket = {words}").inputFiles()) <= every
    plan = index.containing(texts, "id", path, "w77x59")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    found = index._postings(spark, path, lambda c: c == "w77x59")
    found.collect()
    assert [r.key for r in index.containing(texts, "id", path, "common").select("key").orderBy("key").collect()] == list(range(300))
    one = [f for f in spark.read.parquet(f"{path}/postings").inputFiles() if f"bucket={words}/" in f]
    assert 0 < size(one) < every / 8
