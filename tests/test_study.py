"""The market model of each event against plain least squares."""

import datetime
import random

import numpy as np

from deltascope.operators import study

D = datetime.date(2020, 1, 1)
WINDOWS = {"car3": 3, "car1": 1, "car10": 10}


def plain(events, daily, least=20):
    out = {}
    for key, by, at in events:
        own = sorted((d, y, x) for b, d, y, x in daily if b == by and y is not None and x is not None)
        est = [(y, x) for d, y, x in own if at - datetime.timedelta(170) <= d <= at - datetime.timedelta(10)] if at else []
        if len(est) < least:
            continue
        y, x = np.array(est).T
        var = ((x - x.mean()) ** 2).sum()
        beta = ((y - y.mean()) * (x - x.mean())).sum() / var if var > 1e-10 else 1.0
        alpha = y.mean() - beta * x.mean()
        cars = {}
        for name, last in WINDOWS.items():
            after = [b - (alpha + beta * a) for d, b, a in own if at <= d <= at + datetime.timedelta(last + 5)][: last + 1]
            cars[name] = sum(after) if after else None
        if cars["car3"] is not None:
            out[key] = (len(est), beta, alpha, *cars.values())
    return out


def test_market_model(spark):
    rng = random.Random(8)
    daily = []
    for by in range(4):
        for k in range(600):
            if rng.random() < (0.6, 0.9, 0.15, 0.5)[by] and not 300 <= k < 330:
                x = 0.0 if by == 3 else rng.gauss(0, 0.02)
                daily.append((by, D + datetime.timedelta(k), None if rng.random() < 0.05 else 0.3 * x + rng.gauss(0, 0.01), None if rng.random() < 0.05 else x))
    events = [(i, rng.randrange(5), D + datetime.timedelta(rng.randrange(-50, 650))) for i in range(400)] + [(1000, None, D), (1001, 1, None)]
    frame = spark.createDataFrame(daily, "ticker int, day date, ret double, bench double")
    own = spark.createDataFrame(events, "id long, ticker int, filed date")
    for salts in (1, 5):
        got = {r[0]: tuple(r)[1:] for r in study.market_model(own, frame, "id", "ticker", "filed", windows=WINDOWS, salts=salts).collect()}
        want = plain(events, daily)
        assert set(got) == set(want) and len(want) > 100
        for k, row in want.items():
            for a, b in zip(got[k], row):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert any(r[2] == 1.0 for r in got.values()) or any(abs(r[1] - 1.0) < 1e-12 for r in got.values())
    assert study.market_model(own.limit(0), frame, "id", "ticker", "filed").count() == 0
    assert study.market_model(own, frame.limit(0), "id", "ticker", "filed").count() == 0


def test_summary_falls_back(spark):
    rows = [(1, 0.1, 0.0, None), (1, -0.3, 0.2, 0.0), (2, None, 1.0, 1.0)]
    got = {r["k"]: r for r in study.summary(spark.createDataFrame(rows, "k int, a double, b double, c double"), "k", "a", ["b", "c"]).collect()}
    assert abs(got[1]["mean_b"] - 0.15) < 1e-12 and abs(got[1]["mean_c"] + 0.1) < 1e-12 and got[1]["hit_rate"] == 0.5
