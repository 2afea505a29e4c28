"""The detection from points to analytes, on spectra that hold the customers as envelopes: what it finds is known, and SQL says it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.scalars import AVERAGINE_LAMBDA, C13_STEP, PROTON
from spectraloom.operators import detect, envelopes
from spectraloom.operators.graph import settled
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Files, isotopes of an envelope, scans on either side of its top, scans from top to top in a file.
_FILES, _ISOTOPES, _HALF, _STEP = 64, 5, 8, 24

#: Customers as envelopes: of a charge of 1 to 3, every other one at the next charge, too; one at a time in each file.
_PLANTED = f"""
WITH c AS (SELECT c_custkey, c_custkey % {_FILES} AS file_id, 12 + {_STEP} * CAST(floor(c_custkey / {_FILES}) AS BIGINT) AS apex, CAST(800 + (c_custkey % 997) * 2.1 AS DOUBLE) AS mass, c_custkey % 3 + 1 AS z FROM customer),
e AS (SELECT file_id, c_custkey, apex, mass, CAST(z AS INTEGER) AS charge FROM c UNION ALL SELECT file_id, c_custkey, apex, mass, CAST(z + 1 AS INTEGER) FROM c WHERE c_custkey % 2 = 0)
"""


def envelope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, key, apex, z, i, mean, area): the isotopes of each customer's envelopes, by Poisson weights."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        (key % _FILES).alias("file_id"), key.alias("key"), (12 + _STEP * F.floor(key / _FILES)).alias("apex"), (800 + (key % 997) * 2.1).alias("mass"), F.explode(F.when(key % 2 == 0, F.array(key % 3 + 1, key % 3 + 2)).otherwise(F.array(key % 3 + 1))).alias("z")
    )
    i, rate = F.col("i"), F.col("mass") * AVERAGINE_LAMBDA
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_ISOTOPES - 1))))
    area = 1e6 * F.pow(rate, i) * F.exp(-rate) / F.factorial(i)
    return c.select("file_id", "key", "apex", "z", "i", (F.col("mass") / F.col("z") + PROTON + i * C13_STEP / F.col("z")).alias("mean"), area.alias("area"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, scan, rt, mz, intensity): the isotopes as bells over their scans."""
    c = envelope_lines(spark, sf_dir).withColumn("dt", F.explode(F.sequence(F.lit(-_HALF), F.lit(_HALF))))
    scan = F.col("apex") + F.col("dt")
    return c.select("file_id", scan.alias("scan"), (scan * 0.01).alias("rt"), F.col("mean").alias("mz"), (F.col("area") * F.exp(-F.col("dt") * F.col("dt") / 18.0)).alias("intensity"))


def _features(spark: SparkSession, sf_dir: str, traced: bool = False) -> DataFrame:
    """Features, with their traces if asked. What is cut stays with its line's task, where its features are made."""
    points = settled(detect.lines(planted(spark, sf_dir)), "lines")
    return detect.features(detect.pieces(points, detect.line_table(points)), traced)


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = settled(_features(spark, sf_dir, True), "features")
    return envelopes.with_bounds(envelopes.distributions(feats, feats.select("file_id", "feature_id", F.inline("trace"))), feats)


@query(f"""{_PLANTED}, i AS (SELECT *, unnest(range({_ISOTOPES})) AS i FROM e)
SELECT file_id, round(mass / charge + {PROTON} + i * {C13_STEP} / charge, 4) AS mz_mean, round((apex - {_HALF}) * CAST(0.01 AS DOUBLE), 4) AS rt_start, round(apex * CAST(0.01 AS DOUBLE), 4) AS rt_apex, round((apex + {_HALF}) * CAST(0.01 AS DOUBLE), 4) AS rt_end,
  CAST({2 * _HALF + 1} AS BIGINT) AS n_points FROM i""")
def d07_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points followed as lines, long lines cut, a row a piece."""
    return _features(spark, sf_dir).select("file_id", *[F.round(c, 4).alias(c) for c in ("mz_mean", "rt_start", "rt_apex", "rt_end")], "n_points")


@query(f"""{_PLANTED} SELECT file_id, charge, round(mass, 2) AS neutral_mass, round(apex * CAST(0.01 AS DOUBLE), 4) AS rt_apex_near, CAST({_ISOTOPES} AS BIGINT) AS n_members, true AS strict FROM e""")
def d18_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined to ladders, scored, and chosen by the best totals; pieces merged."""
    got = _distributions(spark, sf_dir)
    return got.select("file_id", "charge", F.round("neutral_mass", 2).alias("neutral_mass"), F.round("rt_apex", 4).alias("rt_apex_near"), "n_members", (F.col("status") != "recovered").alias("strict"))


@query(f"""{_PLANTED} SELECT file_id, round(mass, 2) AS neutral_mass, min(charge) AS charge_min, max(charge) AS charge_max, count(*) AS n_distributions FROM e GROUP BY file_id, apex, mass""")
def d21_analytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of one mass and time at different charges."""
    got = settled(_distributions(spark, sf_dir), "distributions")
    grouped = detect.analytes(got).join(got.select("file_id", "distribution_id", "charge", "neutral_mass").hint("merge"), ["file_id", "distribution_id"])
    out = grouped.groupBy("file_id", "analyte_id").agg(F.round(F.avg("neutral_mass"), 2).alias("neutral_mass"), F.min("charge").alias("charge_min"), F.max("charge").alias("charge_max"), F.count("*").alias("n_distributions"))
    return out.drop("analyte_id")
