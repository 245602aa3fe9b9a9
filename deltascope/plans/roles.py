"""The engine's roles bound to the star-schema tables: companies, filings, lines of filings, alerts.

``SQL`` states the same bindings for the oracle; queries append to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.tables import read

#: Orders' priorities stand for form types.
FORMS = {"1-URGENT": "8-K", "2-HIGH": "10-Q", "3-MEDIUM": "10-K", "4-NOT SPECIFIED": "10-K/A", "5-LOW": "4"}
FORM_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '10-K' WHEN '4-NOT SPECIFIED' THEN '10-K/A' ELSE '4' END"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.lit("4")
    for priority, name in FORMS.items():
        form = F.when(F.col("o_orderpriority") == priority, name).otherwise(form)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"), form.alias("form"), F.to_date("o_orderdate").alias("filed"), (F.col("o_orderstatus") != "P").alias("fetched"), F.col("o_totalprice").alias("amount"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a filing, measured in whole cents and percents so that sums are exact in any order."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("source"), cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
        F.col("l_quantity").cast("long").alias("words"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("shipped"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a filing: materiality, burial and coverage from its lines, then gap and rank. Scores are rounded (half up) in
    whole numbers, so that a tie is a tie on every engine."""
    own = lines(spark, sf_dir).groupBy("accession").agg(F.sum("disc").alias("d"), F.sum("tax").alias("t"), F.count("*").alias("n"))
    hundredths = lambda x: F.expr(f"least(10000, (2 * ({x}) + n) div (2 * n))")  # noqa: E731  # of x / n, 100 at most
    own = own.withColumn("m", hundredths("1000 * d")).withColumn("b", hundredths("1200 * t"))
    out = own.join(filings(spark, sf_dir), "accession").select(
        "accession", "cik", "form", "filed", F.col("n").alias("articles"), (F.col("m") / F.lit(100.0)).alias("materiality"), (F.col("b") / F.lit(100.0)).alias("burial"),
        (F.col("n") / F.lit(7.0)).alias("coverage"), (F.expr("(14 * m + n) div (2 * n)") / F.lit(100.0)).alias("gap"))
    return out.withColumn("ranking", scores.alert_rank(F.col("materiality"), F.col("burial"), F.col("gap")))


SQL = f"""WITH companies AS (
  SELECT c_custkey AS cik, c_name AS name, r_name AS sector, n_name AS nation, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
filings AS (
  SELECT o_orderkey AS accession, o_custkey AS cik, {FORM_SQL} AS form, CAST(o_orderdate AS DATE) AS filed, o_orderstatus <> 'P' AS fetched, o_totalprice AS amount FROM orders),
lines AS (
  SELECT l_orderkey AS accession, l_linenumber AS seq, l_suppkey AS source, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc,
         CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS words, l_returnflag AS flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS shipped FROM lineitem),
alert0 AS (
  SELECT accession, n, least(10000, (2000 * d + n) // (2 * n)) AS m, least(10000, (2400 * t + n) // (2 * n)) AS b
  FROM (SELECT accession, CAST(sum(disc) AS BIGINT) AS d, CAST(sum(tax) AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY accession)),
alert1 AS (
  SELECT accession, cik, form, filed, n AS articles, m / 100.0::DOUBLE AS materiality, b / 100.0::DOUBLE AS burial, n / 7.0::DOUBLE AS coverage, ((14 * m + n) // (2 * n)) / 100.0::DOUBLE AS gap
  FROM alert0 JOIN filings USING (accession)),
alerts AS (SELECT *, CAST(CASE WHEN s >= 80 THEN 5 WHEN s >= 60 THEN 4 WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END AS INTEGER) AS ranking
  FROM (SELECT *, 0.5 * materiality + 0.3 * burial + 0.2 * least(gap, 100.0) AS s FROM alert1))
"""
