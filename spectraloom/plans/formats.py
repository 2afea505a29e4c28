"""File formats written and read again on stand-in tables, and what is read off them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.functions import shapes
from spectraloom.operators import graph
from spectraloom.sources import mzml_out, spectra, sqlite
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _done(made: DataFrame) -> None:
    """Writes the files that the rows tell of."""
    made.write.format("noop").mode("overwrite").save()


@query("SELECT p_brand AS brand, p_partkey, p_name, p_size, p_retailprice, CAST(p_size AS DOUBLE) AS size, CAST(p_size AS DOUBLE) / 2 AS half FROM part")
def snk1_sqlite_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, by way of one database a brand."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    rows = p.select(F.col("p_brand").alias("file_id"), "p_brand", "p_partkey", "p_name", "p_size", "p_retailprice", F.array(size, size / 2).alias("sizes"))
    path = graph.scratch(spark, "sqlite")
    _done(sqlite.write_stores({"parts": rows}, path, index={"parts": ["p_partkey"]}))
    back = sqlite.read_table(spark, path, "parts", "p_brand string, p_partkey long, p_name string, p_size int, p_retailprice double, sizes array<float>")
    return back.select(F.col("p_brand").alias("brand"), "p_partkey", "p_name", "p_size", "p_retailprice", F.col("sizes")[0].cast("double").alias("size"), F.col("sizes")[1].cast("double").alias("half"))


#: A user's events of an hour are a spectrum, with values as m/z and as intensities.
SPECTRA = """WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS hour, value FROM events),
s AS (SELECT user_id, hour, row_number() OVER (PARTITION BY user_id ORDER BY hour) - 1 AS scan, count(*) AS n, sum(value) AS tic FROM e GROUP BY 1, 2)
"""


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' spectra by way of a mzML file a user."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    g = table(spark, sf_dir, "events").select("user_id", hour.alias("hour"), "value").groupBy("user_id", "hour").agg(F.array_sort(F.collect_list("value")).alias("mz"))
    none = {"precursor_ref": "string", "precursor_mz": "double", "precursor_charge": "int", "isolation_low": "double", "isolation_high": "double", "collision_energy": "double"}
    kind = F.when(F.col("hour") % 5 == 0, "profile").otherwise("centroid")
    rows = g.select(
        F.col("user_id").alias("run"), F.concat(F.lit("scan="), F.col("hour").cast("string")).alias("spectrum_id"), F.col("hour").alias("spectrum_index"), F.lit(1).alias("ms_level"),
        kind.alias("kind"), (F.col("hour") / 60).alias("rt"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "mz", F.col("mz").alias("intensity"),
    )
    path = graph.scratch(spark, "mzml")
    _done(mzml_out.write_mzml(rows, path))
    return spectra.read_mzml(spark, path)


def _user():
    return F.regexp_extract("file", r"([^/]*)\.mzML$", 1).cast("long").alias("user_id")


@query(SPECTRA + "SELECT user_id, CAST(scan AS BIGINT) AS scan, hour, CAST(n AS BIGINT) AS n_points, round(tic, 4) AS tic FROM s")
def src1_mzml_ms1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectra.ms1(_spectra(spark, sf_dir))
    return found.select(_user(), "scan", F.col("scan_number").cast("long").alias("hour"), F.col("n_points").cast("long").alias("n_points"), F.round("tic", 4).alias("tic"))


@query(SPECTRA + "SELECT user_id, CAST(count(*) FILTER (WHERE hour % 5 = 0) AS BIGINT) AS profile, CAST(count(*) FILTER (WHERE hour % 5 <> 0) AS BIGINT) AS centroid, CASE WHEN min(hour % 5) > 0 THEN 'centroid' WHEN max(hour % 5) = 0 THEN 'profile' ELSE 'mixed' END AS class FROM s GROUP BY 1")
def a23_mzml_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.level_report(_spectra(spark, sf_dir)).select(_user(), "profile", "centroid", "class")


@query(
    SPECTRA
    + """SELECT s.user_id, CAST(s.scan AS BIGINT) AS scan, CAST(target AS DOUBLE) AS target, round(sum(CASE WHEN value >= target - 2 AND value <= target + 2 THEN value ELSE 0 END), 4) AS intensity
FROM s JOIN e ON e.user_id = s.user_id AND e.hour = s.hour CROSS JOIN (SELECT unnest([5.0, 20.0, 60.0]) AS target) GROUP BY 1, 2, 3"""
)
def a25_mzml_chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectra.chromatograms(spectra.ms1(_spectra(spark, sf_dir)), [5.0, 20.0, 60.0], 10.0, 2.0)
    return found.select(_user(), "scan", "target", F.round("intensity", 4).alias("intensity"))


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount IS NULL THEN 0 ELSE least(1, greatest(0, (log10(greatest(l_discount, 1e-6)) + 4) / (log10(0.05) + 4))) END, 6) AS even,
  round(least(1, greatest(0, greatest(l_discount, 1e-6) / 0.05)), 6) AS straight FROM lineitem""")
def sc26_q_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.q_position(q), 6).alias("even"), F.round(S.q_position(q, True), 6).alias("straight"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS s, l_quantity AS e, count(*) OVER w AS n, sum(l_extendedprice) OVER w AS st, sum(l_quantity) OVER w AS et FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
r AS (SELECT *, s * et / st AS v, lag(s) OVER w AS s0, lag(e) OVER w AS e0 FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, s, e))
SELECT l_orderkey, round((sum(abs(v - e) / e) / any_value(n) + sum(abs(s / s0 - e / e0) / (e / e0)) / (any_value(n) - 1)) / 2, 6) AS deviation FROM r WHERE n > 1 GROUP BY 1""")
def i20_shape_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of an order's line items as peaks, their quantities as the expected ones."""
    one = F.struct("l_linenumber", "l_extendedprice", "l_quantity")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("p")).where(F.size("p") > 1)
    return g.select("l_orderkey", F.round(shapes.shape_deviation(F.col("p.l_extendedprice"), F.col("p.l_quantity")), 6).alias("deviation"))
