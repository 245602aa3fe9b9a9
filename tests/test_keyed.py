"""Monitors with keyed state, restarted between micro-batches, against plain loops over the same rows."""

import datetime
import random

import pytest

from deltascope.streaming import keyed, monitor

T0 = datetime.datetime(2024, 1, 1)


def minute(n):
    return T0 + datetime.timedelta(minutes=n)


@pytest.fixture()
def replay(spark, tmp_path):
    """Runs a monitor over files that come one by one; every file is a new start from the checkpoint."""

    def run(schema, files, build, out):
        source, got = tmp_path / "in", []
        source.mkdir()

        def sink(batch, _):
            got.extend(tuple(r) for r in batch.select(*out).collect())

        for i, rows in enumerate(files):
            frame = spark.createDataFrame(rows, schema)
            frame.coalesce(1).write.parquet(f"{source}/part={i}")
            stream = spark.readStream.schema(schema).parquet(f"{source}/part=*")
            keyed.started(spark, lambda: monitor.run(build(stream), sink, str(tmp_path / "state"))).awaitTermination()
        return got

    return run


def in_files(rows, n, at):
    """Rows in ``n`` files by time, in any order within a file."""
    rows = sorted(rows, key=at)
    size = -(-len(rows) // n)
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    for f in files:
        random.Random(1).shuffle(f)
    return files


def test_newest_ids(replay):
    rng = random.Random(3)
    times = rng.sample(range(5000), 240)
    rows = [(rng.choice("ab"), rng.randrange(30), minute(t), None if n % 9 == 4 else 2**60 + n) for n, t in enumerate(times)]
    got = replay("feed string, id int, at timestamp, _n long", in_files(rows, 3, lambda r: r[2]) + [[(None, 1, minute(6000), -1), ("a", None, minute(6000), -2), ("a", 1, None, -3)]],
                 lambda s: keyed.newest_ids(s, "feed", "id", "at", bound=7), ["_n"])
    want, known = [], {"a": [], "b": []}
    for feed, i, _, n in sorted(rows, key=lambda r: r[2]):
        if i not in known[feed]:
            known[feed] = (known[feed] + [i])[-7:]
            want.append((n,))
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) < len(rows)


def test_throttle(replay):
    rng = random.Random(5)
    rows = [(rng.randrange(3), minute(rng.randrange(8000)), n) for n in range(200)]
    got = replay("k int, at timestamp, n int", in_files(rows, 3, lambda r: r[1]) + [[(None, minute(9000), -1)]], lambda s: keyed.throttled(s, "k", "at", ["n"]), ["k", "at"])
    want = []
    for k in range(3):
        last = None
        for t in sorted(t for c, t, _ in rows if c == k):
            if last is None or t - last >= datetime.timedelta(hours=6):
                want.append((k, t))
                last = t
    assert sorted(r for r in got if r[0] is not None) == sorted(want) and all(r[0] is not None for r in got)


def test_changing_mutes(replay):
    rng = random.Random(7)
    times = rng.sample(range(9000), 200)
    rows = []
    for n, t in enumerate(times):
        kind = rng.choice(["entry", "entry", "entry", "mute", "unmute"])
        until = minute(t + rng.randrange(60, 2000)) if kind == "mute" else None
        rows.append((rng.randrange(3), minute(t), n, kind, until))
    rows += [(9, minute(100), 900, "entry", None), (9, minute(100), 901, "mute", minute(130))]  # the command of equal time comes first

    def build(s):
        said = s.where("kind <> 'entry'").select("k", "at", "until")
        return keyed.muted_by(s.where("kind = 'entry'").select("k", "at", "n"), said, "k", "at", "until", ["n"])

    got = replay("k int, at timestamp, n int, kind string, until timestamp", in_files(rows, 3, lambda r: r[1]), build, ["n"])
    want, held = [], {}
    for k, t, n, kind, until in sorted(rows, key=lambda r: (r[1], r[3] == "entry", r[2])):
        if kind != "entry":
            held[k] = until
        elif held.get(k) is None or t >= held[k]:
            want.append((n,))
    assert sorted(got) == sorted(want) and len(want) < sum(r[3] == "entry" for r in rows)
