"""Changes of stored tables: rows, files that stay, reruns."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from deltascope.operators import changes, stored


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/_bucket=*/part-*")}


def rows(spark, path, schema):
    return sorted(map(tuple, stored.read(spark, path, schema).collect()), key=str)


def test_changes_touch_only_their_folders(spark):
    path = tempfile.mkdtemp(prefix="stored-") + "/t"
    old = spark.createDataFrame([(i, f"a{i}") for i in range(300)] + [(None, "none")], "k long, v string")
    stored.create(old, ["k"], path, 16)
    before = files(path)
    assert rows(spark, path, old.schema) == sorted(map(tuple, old.collect()), key=str)
    new = spark.createDataFrame([(5, "new"), (1000, "more")], "k long, v string")
    upsert = lambda a, b: changes.upsert(a, b, ["k"])
    written = stored.change(spark, path, old.schema, ["k"], new, upsert, 16)
    assert 1 <= len(written) <= 2
    after = files(path)
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in written)}
    assert kept <= set(after) and all(before[f] == after[f] for f in kept) and len(kept) >= 14
    want = sorted([(i, "new" if i == 5 else f"a{i}") for i in range(300)] + [(None, "none"), (1000, "more")], key=str)
    assert rows(spark, path, old.schema) == want
    assert stored.change(spark, path, old.schema, ["k"], new, upsert, 16) == [] and files(path) == after
    assert stored.change(spark, path, old.schema, ["k"], new.limit(0), upsert, 16) == []
    gone = spark.createDataFrame([(i,) for i in range(300)] + [(1000,)], "k long")
    stored.change(spark, path, old.schema, ["k"], gone, lambda a, b: a.join(b, "k", "left_anti").select("k", "v"), 16)
    assert rows(spark, path, old.schema) == [(None, "none")] and len(files(path)) == 1


def test_a_change_that_fails_leaves_the_table(spark):
    path = tempfile.mkdtemp(prefix="stored-") + "/t"
    old = spark.createDataFrame([(i, i) for i in range(50)], "k long, v long")
    stored.create(old, ["k"], path, 4)
    before = files(path)
    try:
        stored.change(spark, path, old.schema, ["k"], old, lambda a, b: a.withColumn("v", F.raise_error(F.lit("lost"))), 4)
    except Exception as e:
        assert "lost" in str(e)
    assert files(path) == before and len(rows(spark, path, old.schema)) == 50
