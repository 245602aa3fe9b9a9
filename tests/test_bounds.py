"""Scores that stand exactly on a threshold, and sentences that begin or end with digits."""

import datetime
import random

from deltascope import registry
from deltascope.functions import text as T
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 1)


def star(spark, path, lines):
    """Tables of one line a (customer, order, discount, tax, flag); every customer is Asian."""
    frames = {
        "lineitem": ([(o, k, 1, 1, d, t, 1.0, f, "O", DAY) for k, (_, o, d, t, f) in enumerate(lines)], "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate date"),
        "orders": (sorted({(o, c, "5-LOW", DAY, "O", 1.0) for c, o, *_ in lines}), "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date, o_orderstatus string, o_totalprice double"),
        "customer": (sorted({(c, "c", 1, "s", 0.0) for c, *_ in lines}), "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "nation": ([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in frames.items():
        rows = [(r[0], r[1], r[2], float(r[3]), *r[4:]) if name == "lineitem" else r for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_scores_exactly_two_deviations_away(spark, tmp_path):
    # the lowest of these filings is two deviations away; sums of binary fractions miss that in many orders of the rows
    filed = [(3, 0, 3), (5, 3, 7, 6, 4), (6, 2, 7, 7), (8, 7, 7, 1, 4, 3), (3, 7), (9, 6, 5, 8), (7, 8, 0, 7)]
    rng = random.Random(3)
    lines = [(99, 900 + k, 0.03, 0.0, "N") for k in range(4)]
    for c in range(20):
        keys = [c * 10 + 1000 + k for k in range(7)]
        rest = rng.sample(filed[1:], 6)
        lines += [(c, o, d / 100, 0.0, "N") for o, ds in zip(keys, [filed[0], *rest]) for d in ds]
    got = registry.queries()["trend_anomalies"](spark, star(spark, tmp_path, lines)).collect()
    assert sorted((r.accession, r.z) for r in got) == [(c * 10 + 1000, -2.0) for c in range(20)]


def test_rank_exactly_at_two_thirds_of_a_threshold(spark, tmp_path):
    # 29 lines, 6 of them returned, taxes of 150 percent: a score of 30.15, which is 0.67 * 45
    lines = [(1, 1, 0.0, 0.08 if k < 18 else 0.06 if k == 18 else 0.0, "R" if k < 6 else "N") for k in range(29)]
    assert [r.sector_rank for r in registry.queries()["sector_calibrated_gap"](spark, star(spark, tmp_path, lines)).collect()] == ["MEDIUM"]


def test_sentences_keep_the_digits_at_their_ends(spark):
    text = "First of all sentences here. 1111111111 of them are. 2 more than twenty signs 2"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == ["First of all sentences here.", "1111111111 of them are.", "2 more than twenty signs 2"]
