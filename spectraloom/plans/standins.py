"""The driver's tables seen as the detection's and the search's tables, in SQL and as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.sources.tables import table

#: The detection's tables: parts are features, orders are distributions, line items are members, customers' orders are analytes.
STORE = """
WITH features AS (SELECT 1 AS file_id, p_partkey AS feature_id, p_retailprice AS mz_mean, p_retailprice - 0.5 AS mz_min, p_retailprice + 0.5 AS mz_max,
  CAST(p_size AS DOUBLE) AS rt_start, p_size + 1.0 AS rt_apex, p_size + 2.0 AS rt_end, CAST(p_size AS BIGINT) AS n_points, round(p_retailprice * p_size, 2) AS area FROM part),
distributions AS (SELECT *, (mono_mz - 1.007276554940804) * charge AS neutral_mass FROM (
  SELECT 1 AS file_id, o_orderkey AS distribution_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS charge, o_totalprice / 100 AS mono_mz,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0 AS rt_start, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0 + (CAST(floor(o_totalprice) AS BIGINT) % 700) / 100.0 AS rt_end,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 9 + 2 AS BIGINT) AS n_members, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0 AS score, o_totalprice AS quality,
  CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'recovered' ELSE 'ambiguous' END AS status FROM orders)),
members AS (SELECT 1 AS file_id, l_orderkey AS distribution_id, l_partkey AS feature_id, l_linenumber AS isotope_index FROM lineitem WHERE l_quantity > 30),
analyte_members AS (SELECT 1 AS file_id, o_custkey AS analyte_id, o_orderkey AS distribution_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS charge FROM orders),
analytes AS (SELECT 1 AS file_id, analyte_id, min(charge) AS charge_min, max(charge) AS charge_max, CAST(count(*) AS BIGINT) AS n_distributions, round(max(score), 4) AS score
  FROM analyte_members JOIN (SELECT distribution_id, score FROM distributions) USING (distribution_id) GROUP BY 2)
"""


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that STORE names."""
    one = F.lit(1).alias("file_id")
    p, size, price = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_retailprice")
    features = p.select(
        one, F.col("p_partkey").alias("feature_id"), price.alias("mz_mean"), (price - 0.5).alias("mz_min"), (price + 0.5).alias("mz_max"), size.cast("double").alias("rt_start"),
        (size + 1.0).alias("rt_apex"), (size + 2.0).alias("rt_end"), size.cast("long").alias("n_points"), F.round(price * size, 2).alias("area"),
    )
    o, total = table(spark, sf_dir, "orders"), F.floor("o_totalprice")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 10.0
    charge = F.substring("o_orderpriority", 1, 1).cast("int").alias("charge")
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "recovered").otherwise("ambiguous")
    dists = o.select(
        one, F.col("o_orderkey").alias("distribution_id"), charge, (F.col("o_totalprice") / 100).alias("mono_mz"), day.alias("rt_start"), (day + (total % 700) / 100.0).alias("rt_end"),
        (total % 9 + 2).alias("n_members"), ((total % 1000) / 1000.0).alias("score"), F.col("o_totalprice").alias("quality"), status.alias("status"),
    ).withColumn("neutral_mass", (F.col("mono_mz") - 1.007276554940804) * F.col("charge"))
    members = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(one, F.col("l_orderkey").alias("distribution_id"), F.col("l_partkey").alias("feature_id"), F.col("l_linenumber").alias("isotope_index"))
    in_analytes = o.select(one, F.col("o_custkey").alias("analyte_id"), F.col("o_orderkey").alias("distribution_id"), charge)
    analytes = in_analytes.join(dists.select("distribution_id", "score"), "distribution_id").groupBy("file_id", "analyte_id")
    analytes = analytes.agg(F.min("charge").alias("charge_min"), F.max("charge").alias("charge_max"), F.count("*").alias("n_distributions"), F.round(F.max("score"), 4).alias("score"))
    return {"features": features, "distributions": dists, "members": members, "analyte_members": in_analytes, "analytes": analytes}
