"""Charge grids and interval scores on stand-in tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.scalars import PROTON
from spectraloom.operators import charges as O
from spectraloom.plans.standins import STORE, store
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Of each analyte and charge the first distribution; a feature's points are its height.
GRID = f"""{STORE}, one AS (SELECT analyte_id, charge, min(distribution_id) AS distribution_id FROM analyte_members GROUP BY 1, 2),
p AS (SELECT analyte_id, charge, row_number() OVER (PARTITION BY analyte_id, charge ORDER BY isotope_index, mz_mean, n_points, area) - 1 AS i, mz_mean AS mz, CAST(n_points AS DOUBLE) AS h, area,
  mz_mean * charge - CAST({PROTON!r} AS DOUBLE) * charge AS base FROM one JOIN members USING (distribution_id) JOIN features USING (feature_id)),
"""


def _ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    one = s["analyte_members"].groupBy("analyte_id", "charge").agg(F.min("distribution_id").alias("distribution_id"))
    features = s["features"].select("feature_id", "mz_mean", F.col("n_points").cast("double").alias("height"), "area")
    members = s["members"].select("distribution_id", "feature_id", "isotope_index")
    return O.ladders(one.join(members, "distribution_id").join(features, "feature_id"), "analyte_id")


@query(
    GRID
    + """lay AS (SELECT analyte_id, c, o, i - least(i, j) AS a, j - least(i, j) AS b FROM (SELECT x.analyte_id, x.charge AS c, y.charge AS o, x.i AS i, y.i AS j,
  row_number() OVER (PARTITION BY x.analyte_id, x.charge, y.charge ORDER BY abs(y.base - x.base), x.i, y.i) AS n FROM p x JOIN p y ON x.analyte_id = y.analyte_id) WHERE n = 1)
SELECT x.analyte_id, x.charge, y.charge AS other, CAST(x.i AS INTEGER) AS place, round(x.mz, 4) AS mz, round(CASE WHEN x.h > 0 THEN y.h / x.h ELSE 1 END, 6) AS ratio,
  round((y.base - x.base) / CASE WHEN y.base = 0 THEN 1 ELSE y.base END * 1e6, 3) AS error
FROM lay JOIN p x ON x.analyte_id = lay.analyte_id AND x.charge = c JOIN p y ON y.analyte_id = lay.analyte_id AND y.charge = o AND x.i >= a AND y.i = x.i - a + b"""
)
def d26_charge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.pair_grid(_ladders(spark, sf_dir), "analyte_id")
    return rows.select("analyte_id", "charge", "other", "place", F.round("mz", 4).alias("mz"), F.round("ratio", 6).alias("ratio"), F.round("error", 3).alias("error"))


@query(
    GRID
    + """long AS (SELECT analyte_id, arg_min(charge, -n * 1000 + charge) AS l FROM (SELECT analyte_id, charge, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
lay AS (SELECT analyte_id, c, i - least(i, j) AS a, j - least(i, j) AS b FROM (SELECT x.analyte_id, x.charge AS c, x.i AS i, y.i AS j,
  row_number() OVER (PARTITION BY x.analyte_id, x.charge ORDER BY abs(y.base - x.base), x.i, y.i) AS n FROM p x JOIN long ON long.analyte_id = x.analyte_id JOIN p y ON y.analyte_id = x.analyte_id AND y.charge = l) WHERE n = 1),
m AS (SELECT y.analyte_id, y.i, sum(x.base) / count(*) AS base, sum(x.h) AS h FROM lay JOIN long USING (analyte_id) JOIN p x ON x.analyte_id = lay.analyte_id AND x.charge = c JOIN p y ON y.analyte_id = lay.analyte_id AND y.charge = l
  AND x.i >= a AND y.i = x.i - a + b GROUP BY 1, 2),
am AS (SELECT analyte_id, c, i - least(i, j) AS a, j - least(i, j) AS b FROM (SELECT x.analyte_id, x.charge AS c, x.i AS i, m.i AS j,
  row_number() OVER (PARTITION BY x.analyte_id, x.charge ORDER BY abs(m.base - x.base), x.i, m.i) AS n FROM p x JOIN m ON m.analyte_id = x.analyte_id) WHERE n = 1),
w AS (SELECT *, lead(mz) OVER u AS mz1, lead(h) OVER u AS h1 FROM p WINDOW u AS (PARTITION BY analyte_id, charge ORDER BY i))
SELECT w.analyte_id, w.charge, CAST(w.i AS INTEGER) AS place, round(w.mz, 4) AS mz, round(w.area, 2) AS area, round((mz1 - w.mz) * w.charge, 4) AS distance,
  round(CASE WHEN mz1 IS NULL THEN NULL WHEN h1 <= 0 OR w.h = 0 THEN -1 WHEN w.h >= h1 THEN w.h / h1 ELSE -h1 / w.h END, 6) AS adjacency, round(w.h / CASE WHEN s.h > 0 THEN s.h WHEN s.h IS NULL THEN NULL ELSE 1 END, 6) AS share,
  round((m.base - w.base) / CASE WHEN w.base = 0 THEN 1 ELSE w.base END * 1e6, 3) AS to_mean
FROM w JOIN am ON am.analyte_id = w.analyte_id AND am.c = w.charge LEFT JOIN m s ON s.analyte_id = w.analyte_id AND s.i = w.i LEFT JOIN m ON m.analyte_id = w.analyte_id AND w.i >= am.a AND m.i = w.i - am.a + am.b"""
)
def d26_charge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = {"mz": 4, "area": 2, "distance": 4, "adjacency": 6, "share": 6, "to_mean": 3}
    return O.own_grid(_ladders(spark, sf_dir), "analyte_id").select("analyte_id", "charge", "place", *[F.round(c, d).alias(c) for c, d in digits.items()])


#: Line items of an order as intervals.
_INTERVALS = """WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_quantity + 1 + l_discount * 100) AS i, l_quantity AS lo, l_quantity + 1 + l_discount * 100 AS hi FROM lineitem)
"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(lo.alias("lo"), (lo + 1 + F.col("l_discount") * 100).alias("hi")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))


@query(
    _INTERVALS
    + """SELECT a.l_orderkey, round(coalesce(sum(CASE WHEN b.i IS NULL THEN 0 WHEN b.hi > a.lo AND a.hi > b.lo THEN least(a.hi, b.hi) - greatest(a.lo, b.lo) - abs(abs(a.lo - b.lo) - abs(a.hi - b.hi))
  ELSE a.lo - a.hi + b.lo - b.hi END), 0), 4) AS score FROM x a LEFT JOIN x b ON b.l_orderkey = a.l_orderkey AND a.i < b.i GROUP BY 1"""
)
def o03_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("l_orderkey", F.round(O.overlap_score(F.col("x")), 4).alias("score"))


@query(
    _INTERVALS
    + """, c AS (SELECT DISTINCT l_orderkey, v FROM (SELECT l_orderkey, lo AS v FROM x UNION ALL SELECT l_orderkey, hi FROM x)),
s AS (SELECT l_orderkey, v AS a, lead(v) OVER (PARTITION BY l_orderkey ORDER BY v) AS b FROM c), n AS (SELECT l_orderkey, count(*) AS n FROM x GROUP BY 1),
k AS (SELECT s.l_orderkey, a, count(*) AS k, sum((b - a) / (hi - lo)) AS share FROM s JOIN x ON x.l_orderkey = s.l_orderkey AND a < hi AND b > lo WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT n.l_orderkey, round(coalesce(sum((2 * k - n) * pow(share * k, (2 * k - n) / n)), 0), 4) AS score FROM n LEFT JOIN k USING (l_orderkey) GROUP BY 1"""
)
def o06_stack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("l_orderkey", F.round(O.stack_score(F.col("x")), 4).alias("score"))
