"""JSON paths, limiters and files as data."""

import datetime
import hashlib
import json
import random
import tempfile
from collections import deque

from pyspark.sql import functions as F

from deltascope.operators import changes, temporal
from deltascope.sources import sinks

T0 = datetime.datetime(2024, 1, 1)


def test_json_set_keeps_all_other_keys(spark):
    docs = ['{"k": 1, "a": {"b": [1, 2.5, "x", null]}, "label": "old"}', "{}", '{"z": null, "big": 12345678901234567890}', None, "[1]", "broken {", '{"label": {"deep": 1}, "é": "ü\\"q"}']
    frame = spark.createDataFrame([(i, d, v) for i, d in enumerate(docs) for v in ('n"ew', None)], "i int, d string, v string")
    for r in frame.select("i", "v", changes.json_set(F.col("d"), "label", F.col("v")).alias("out")).collect():
        try:
            own = json.loads(docs[r.i]) if docs[r.i] else {}
        except ValueError:
            own = {}
        assert json.loads(r.out) == (own if isinstance(own, dict) else {}) | {"label": r.v}


def test_sliding_log(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 1, 2]), T0 + datetime.timedelta(seconds=rng.randrange(0, 3000))) for i in range(900)] + [(1000, None, T0), (1001, 1, None)]
    want = {}
    for user in range(3):
        passed = deque()
        for t, i in sorted((t, i) for i, u, t in rows if u == user and t):
            while passed and (t - passed[0]).total_seconds() >= 60:
                passed.popleft()
            want[i] = len(passed) < 3
            if want[i]:
                passed.append(t)
    got = {r.id: r.allowed for r in temporal.sliding_log(spark.createDataFrame(rows, "id long, u int, t timestamp").repartition(4), "id", "u", "t", 3, 60).collect()}
    assert got == want and len(set(want.values())) == 2


def test_feeds_manifest_and_stale_files(spark):
    folder = tempfile.mkdtemp(prefix="feeds-")
    rows = [(k, i, f"n{i}") for i in range(60) for k in [i % 4]]
    frame = spark.createDataFrame(rows, "k int, i int, name string").repartition(7)
    got = {r.key: r for r in sinks.write_feeds(frame, "k", F.to_json(F.struct("i", "name")), "i", folder).collect()}
    assert set(got) == {"0", "1", "2", "3"}
    for k, r in got.items():
        body = "".join(json.dumps({"i": i, "name": n}, separators=(",", ":")) + "\n" for x, i, n in rows if x == int(k)).encode()
        assert (r.bytes, r.sha256) == (len(body), hashlib.sha256(body).hexdigest())
    again = {r.key: r.sha256 for r in sinks.write_feeds(frame, "k", F.to_json(F.struct("i", "name")), "i", folder).collect()}
    assert again == {k: r.sha256 for k, r in got.items()}
    assert sinks.stale_files(spark, f"{folder}/feeds", 3600).where("stale").count() == 0
    assert sinks.stale_files(spark, f"{folder}/feeds", -3600).where("stale").count() >= 4
