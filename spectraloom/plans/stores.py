"""The store's look-ups and reports on stand-in tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import store as O
from spectraloom.plans.standins import STORE, store

QUERIES, ORACLES = {}, {}


def query(sql: str, start: str = STORE):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, start + sql
        return f

    return add


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


@query("SELECT distribution_id, charge, round(mono_mz, 4) AS mono_mz, status FROM distributions WHERE mono_mz BETWEEN 500 AND 2000 AND rt_end >= 50 AND rt_start <= 200 AND status <> 'recovered' ORDER BY quality DESC, distribution_id LIMIT 200")
def d23_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.in_window(store(spark, sf_dir)["distributions"], (500, 2000), (50, 200), status="primary", limit=200)
    return found.select("distribution_id", "charge", _r("mono_mz"), "status")


@query("SELECT distribution_id, charge FROM distributions WHERE mono_mz >= 100 AND charge = 3 AND status = 'recovered' ORDER BY quality DESC, distribution_id LIMIT 100")
def d23_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.in_window(store(spark, sf_dir)["distributions"], (100, None), charge=3, status="recovered", limit=100).select("distribution_id", "charge")


@query("SELECT 'distribution' AS kind, distribution_id AS id, quality AS value FROM distributions WHERE distribution_id IN (1, 7, 33) UNION ALL SELECT 'feature', feature_id, mz_mean FROM features WHERE feature_id IN (5, 42) UNION ALL SELECT 'analyte', distribution_id, CAST(analyte_id AS DOUBLE) FROM analyte_members WHERE distribution_id = 7")
def d24_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point look-ups: the ids are what is asked for."""
    s = store(spark, sf_dir)
    row = lambda rows, kind, i, v: rows.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(v).cast("double").alias("value"))
    a = row(O.by_id(s["distributions"], "distribution_id", 1, 7, 33), "distribution", "distribution_id", "quality")
    b = row(O.by_id(s["features"], "feature_id", 5, 42), "feature", "feature_id", "mz_mean")
    return a.unionByName(b).unionByName(row(O.by_id(s["analyte_members"], "distribution_id", 7), "analyte", "distribution_id", "analyte_id"))


@query("SELECT m.distribution_id, m.isotope_index, f.feature_id, mz_mean FROM members m JOIN features f USING (feature_id)")
def j06_distribution_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return O.members_of(s["members"], s["features"]).select("distribution_id", "isotope_index", "feature_id", "mz_mean")


@query("SELECT feature_id, mz_min, mz_max, n_points FROM features WHERE mz_min <= 1800 AND mz_max >= 950 AND rt_start <= 40 AND rt_end >= 5 AND NOT EXISTS (SELECT 1 FROM members m WHERE m.feature_id = features.feature_id AND isotope_index <= 2)")
def j07_noise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return O.noise_features(s["features"], s["members"].where("isotope_index <= 2"), (950, 1800), (5, 40)).select("feature_id", "mz_min", "mz_max", "n_points")


@query("SELECT f.feature_id, f.area, coalesce(d.charge, 0) AS charge, CAST(count(*) AS BIGINT) AS n FROM features f LEFT JOIN members m USING (feature_id) LEFT JOIN distributions d ON d.distribution_id = m.distribution_id GROUP BY 1, 2, 3")
def j08_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return O.all_lines(s["features"], s["members"], s["distributions"]).groupBy("feature_id", "area", "charge").agg(F.count("*").alias("n"))


@query("SELECT d.distribution_id, d.charge, round(coalesce(sum(f.area), 0), 2) AS auc FROM distributions d LEFT JOIN members m USING (distribution_id) LEFT JOIN features f ON f.feature_id = m.feature_id GROUP BY 1, 2")
def j09_distribution_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return O.with_area(s["distributions"], s["members"], s["features"]).select("distribution_id", "charge", _r("auc", 2))


@query("""SELECT a.analyte_id, a.charge_min, a.charge_max, min(am.distribution_id) AS rep_distribution_id, round(coalesce(sum(x.auc), 0), 2) AS auc FROM analytes a JOIN analyte_members am USING (analyte_id)
  LEFT JOIN (SELECT distribution_id, sum(area) AS auc FROM members JOIN features USING (feature_id) GROUP BY 1) x ON x.distribution_id = am.distribution_id WHERE charge_max > charge_min GROUP BY 1, 2, 3""")
def j10_multicharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    found = O.multicharge(s["analytes"], s["analyte_members"], s["members"], s["features"])
    return found.select("analyte_id", "charge_min", "charge_max", "rep_distribution_id", _r("auc", 2))


@query("""SELECT am.analyte_id, d.distribution_id, d.charge, round(coalesce(x.auc, 0), 2) AS auc FROM analyte_members am JOIN distributions d USING (distribution_id)
  LEFT JOIN (SELECT distribution_id, sum(area) AS auc FROM members JOIN features USING (feature_id) GROUP BY 1) x ON x.distribution_id = d.distribution_id""")
def j11_analyte_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    found = O.analyte_distributions(s["analyte_members"], s["distributions"], s["members"], s["features"])
    return found.select("analyte_id", "distribution_id", "charge", _r("auc", 2))


@query("""SELECT asked, charge, distribution_id FROM (SELECT a.distribution_id AS asked, b.charge, b.distribution_id, row_number() OVER (PARTITION BY a.distribution_id, b.charge ORDER BY (a.distribution_id = b.distribution_id) DESC, b.distribution_id) AS n
  FROM (SELECT distribution_id, analyte_id FROM analyte_members JOIN (SELECT distribution_id FROM distributions WHERE status = 'ambiguous') USING (distribution_id)) a JOIN analyte_members b ON a.analyte_id = b.analyte_id) WHERE n = 1""")
def j12_charge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return O.charge_groups(s["analyte_members"], s["distributions"].where("status = 'ambiguous'")).select("asked", "charge", "distribution_id")


@query("""SELECT 'miscounted' AS kind, distribution_id AS id, any_value(n_members) AS expected, CAST(count(isotope_index) AS BIGINT) AS observed FROM distributions LEFT JOIN members USING (distribution_id) GROUP BY 2 HAVING any_value(n_members) <> count(isotope_index)
  UNION ALL SELECT 'orphan', distribution_id, 0, CAST(isotope_index AS BIGINT) FROM members WHERE distribution_id NOT IN (SELECT distribution_id FROM distributions WHERE status <> 'ambiguous')""")
def j13_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    odd = O.miscounted(s["distributions"], s["members"], "distribution_id", "n_members").select(F.lit("miscounted").alias("kind"), F.col("distribution_id").alias("id"), "expected", "observed")
    lost = O.orphans(s["members"], s["distributions"].where("status <> 'ambiguous'"), "distribution_id")
    return odd.unionByName(lost.select(F.lit("orphan").alias("kind"), F.col("distribution_id").alias("id"), F.lit(0).cast("long").alias("expected"), F.col("isotope_index").cast("long").alias("observed")))


@query("""SELECT charge, n_members, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM distributions GROUP BY 1, 2""")
def a20_counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.counts_by(store(spark, sf_dir)["distributions"], "charge", "n_members").withColumn("fraction", F.round("fraction", 6))


@query("""SELECT charge_max - charge_min + 1 AS span, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM analytes GROUP BY 1""")
def a20_charge_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.charge_span(store(spark, sf_dir)["analytes"]).withColumn("fraction", F.round("fraction", 6))


@query(
    """SELECT charge, names[i] AS quantile, round(vals[i], 4) AS value FROM (SELECT charge, ['min', 'p01', 'p05', 'p25', 'p50', 'p75', 'p95', 'p99', 'max'] AS names,
  quantile_cont(neutral_mass, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]) AS vals FROM distributions GROUP BY 1), (SELECT unnest(range(1, 10)) AS i)"""
)
def a21_quantile_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.quantile_block(store(spark, sf_dir)["distributions"], "neutral_mass", "charge").withColumn("value", F.round("value", 4))


@query("SELECT 'features' AS name, CAST(count(*) AS BIGINT) AS n FROM features UNION ALL SELECT 'distributions', count(*) FROM distributions UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'analyte_members', count(*) FROM analyte_members UNION ALL SELECT 'analytes', count(*) FROM analytes")
def a22_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.table_counts(store(spark, sf_dir))


@query("SELECT charge, status, CAST(count(*) AS BIGINT) AS n FROM distributions GROUP BY 1, 2")
def a35_charge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.histogram(store(spark, sf_dir)["distributions"], "charge", "status")


def _report(name: str, sql: str, key: str = "distribution_id") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = store(spark, sf_dir)
        return O.reports(s["distributions"], s["analytes"], limit=40, most_mass=6000.0, least_charge=4)[name].select(key)

    QUERIES[f"d25_{name}"], ORACLES[f"d25_{name}"] = run, f"{STORE} SELECT {key} FROM {sql}, {key} LIMIT 40"


_report("tiny_rt", "distributions WHERE rt_end - rt_start <= 0.02 ORDER BY quality, score")
_report("huge_rt", "distributions WHERE rt_end - rt_start >= 5 ORDER BY rt_end - rt_start DESC, quality")
_report("low_score", "distributions WHERE score <= 0.5 ORDER BY score, quality")
_report("high_charge_low_mass", "distributions WHERE charge >= 4 AND neutral_mass <= 6000 ORDER BY charge DESC, neutral_mass")
_report("large_analytes", "analytes WHERE n_distributions >= 10 ORDER BY n_distributions DESC, score DESC", "analyte_id")
_report("most_complex", "distributions ORDER BY n_members DESC, quality DESC")
_report("highest_quality", "distributions ORDER BY quality DESC, score DESC")
