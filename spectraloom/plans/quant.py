"""Quantification queries on the lineitem stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import quantify
from spectraloom.sources.tables import table


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("feature"),
        F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("file"),
        F.col("l_extendedprice").alias("price"),
    )
    return quantify.feature_by_file(rows, "feature", "file", "price")


_MATRIX_SQL = """
WITH m AS (
  SELECT l_partkey AS feature, l_returnflag || '_' || l_linestatus || '_' || CAST(l_linenumber AS VARCHAR) AS file,
         sum(l_extendedprice) AS quantity
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2),
lg AS (SELECT feature, file, log2(quantity) AS log_q FROM m WHERE quantity > 0),
md AS (SELECT file, median(log_q) AS fm FROM lg GROUP BY file),
g AS (SELECT median(fm) AS gm FROM md),
c AS (SELECT feature, lg.file, log_q - fm + gm AS log_q FROM lg JOIN md ON lg.file = md.file CROSS JOIN g)
"""


def a06_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select("feature", "file", F.round("quantity", 2).alias("quantity"))


def a13_median_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quantify.median_center(_matrix(spark, sf_dir), "file")
    return done.select("feature", "file", F.round(F.log2("quantity"), 4).alias("log_quantity"))


def a15_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quantify.median_center(_matrix(spark, sf_dir), "file")
    fc = quantify.fold_change(done, "feature", F.substring("file", 1, 1), "A", "N")
    return fc.select("feature", (F.round("log2_fc", 4) + F.lit(0.0)).alias("log2_fc"), F.round("mean_abundance", 4).alias("mean_abundance"))


QUERIES = {"a06_matrix": a06_matrix, "a13_median_center": a13_median_center, "a15_fold_change": a15_fold_change}
ORACLES = {
    "a06_matrix": _MATRIX_SQL + "SELECT feature, file, round(quantity, 2) AS quantity FROM m",
    "a13_median_center": _MATRIX_SQL + "SELECT feature, file, round(log_q, 4) AS log_quantity FROM c",
    "a15_fold_change": _MATRIX_SQL
    + """, s AS (SELECT feature, avg(CASE WHEN file LIKE 'A%' THEN log_q END) AS a, avg(CASE WHEN file LIKE 'N%' THEN log_q END) AS b
    FROM c GROUP BY feature)
    SELECT feature, round(a - b, 4) + 0.0 AS log2_fc, round((a + b) / 2, 4) AS mean_abundance FROM s WHERE a IS NOT NULL AND b IS NOT NULL""",
}
