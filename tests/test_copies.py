"""Rows that repeat values: what is compared grows with the values, not with their rows, and results are those of the SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import detect
from spectraloom.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = ("part", "supplier")


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Parts and suppliers four times, with keys of their own."""
    folder = tmp_path_factory.mktemp("copies")
    for name, key in zip(TABLES, ("p_partkey", "s_suppkey")):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(key, F.col(key) + 100_000 * F.col("_k")).drop("_k")
        rows.coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def most_met(rows) -> int:
    """The most rows that a join put out when the query ran."""
    rows.collect()
    stack, most = [rows._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        if "Join" in node.nodeName() or "MapInPandas" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return most


def same_as_sql(spark, name: str, folder: str):
    got = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, got.collect())) == key(want)
    return got


def test_j18_best_edge(spark, copies):
    # Joins put out no more than for one copy, but for the rows themselves.
    once = most_met(registry.QUERIES["j18_best_edge"](spark, SMALL))
    assert most_met(same_as_sql(spark, "j18_best_edge", copies)) <= 4 * once


def test_d09_isotope_edges(spark, copies):
    # Joins put out no more than for one copy, but for the rows themselves.
    once = most_met(registry.QUERIES["d09_isotope_edges"](spark, SMALL))
    assert most_met(same_as_sql(spark, "d09_isotope_edges", copies)) <= 4 * once


def test_j21_ppm_band(spark, copies):
    # Joins put out no more than for one copy, but for the rows themselves.
    once = most_met(registry.QUERIES["j21_ppm_band"](spark, SMALL))
    assert most_met(same_as_sql(spark, "j21_ppm_band", copies)) <= 4 * once


def test_j22_nearest(spark, copies):
    got = same_as_sql(spark, "j22_nearest", copies)
    # No pair is met that is not put out.
    assert most_met(got) <= got.count()


def test_j30_offsets(spark, copies):
    got = same_as_sql(spark, "j30_offsets", copies)
    # Pairs of keys are put out as they are met: the last step is a join, no exchange.
    assert "Join" in str(got._jdf.queryExecution().optimizedPlan().toString()).splitlines()[1]


def test_j31_nearest_two_keys(spark, copies):
    # Joins put out no more than for one copy, but for the rows themselves.
    once = most_met(registry.QUERIES["j31_nearest_two_keys"](spark, SMALL))
    assert most_met(same_as_sql(spark, "j31_nearest_two_keys", copies)) <= 4 * once


@pytest.mark.parametrize("name", ["i10_annotated", "j25_best_peaks"])
def test_peaks_are_met_by_exchange(spark, copies, name):
    got = same_as_sql(spark, name, copies)
    assert most_met(got) <= most_met(registry.QUERIES[name](spark, SMALL))


def test_i10_remainder(spark, copies):
    got = same_as_sql(spark, "i10_remainder", copies)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


def test_i10_unmatched(spark, copies):
    got = same_as_sql(spark, "i10_unmatched", copies)
    # At most the parts' own rows: ions of different parts that are equal meet a peak once.
    assert most_met(got) <= 4 * spark.read.parquet(f"{SMALL}/part.parquet").count()


def test_i11_coverage(spark, copies):
    got = same_as_sql(spark, "i11_coverage", copies)
    # The joins put out the candidates at most, and labels of one copy.
    assert most_met(got) <= max(got.count(), most_met(registry.QUERIES["i11_coverage"](spark, SMALL)))


def test_i09_fragment_isotopes(spark, copies):
    once, got = registry.QUERIES["i09_fragment_isotopes"](spark, SMALL), registry.QUERIES["i09_fragment_isotopes"](spark, copies)
    fields = [c for c in once.columns if c != "precursor_id"]
    count = lambda rows: {tuple(r[:-1]): r[-1] for r in rows.groupBy(*fields).count().collect()}
    assert count(got) == {k: 4 * n for k, n in count(once).items()}
    names = spark.read.parquet(f"{SMALL}/part.parquet").select("p_name").distinct().count()
    fragments = once.count() / spark.read.parquet(f"{SMALL}/part.parquet").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert names < 200 and fragments > 0 and plan.index("MapInPandas") < plan.index("Aggregate", plan.index("MapInPandas"))


def test_islands_of_exploded_points(spark):
    # 1,000 rows of a range become 2 million points, which the planner takes for 1,000.
    points = spark.range(1000).select(F.lit(1).alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("scan"), (F.col("id") * 0.7 + 400).alias("mz"))
    found = detect.islands(points, 10.0, 0.004)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.select("island").distinct().count() == 1000


def test_tied_line_items_go_by_their_place(spark, tmp_path):
    # Parts with two line items of one order and number, of suppliers n and 100 - n: the first in the table counts.
    n = F.col("id")
    rows = spark.range(40).select((n % 20).alias("l_partkey"), F.lit(7).cast("long").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.when(n < 20, n).otherwise(100 - n).alias("l_suppkey"))
    rows = rows.select("*", F.lit(2.0).alias("l_quantity"), F.lit(10.0).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("a07_unique", "a08_protein_by_file"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_line_items_that_lack_values(spark, tmp_path):
    # Parts 0 to 4: a first line item that lacks its order, number, supplier or quantity, and one that is whole; part 4 has none that is whole.
    kind = "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    gaps = [(0, None, 1, 7, 2.0), (1, 1, None, 7, 2.0), (2, 1, 1, None, 2.0), (3, 1, 1, 7, None), (4, 1, 1, None, 2.0), (5, 1, 12, 7, 2.0), *[(p, 2, 1, 9, 2.0) for p in (0, 1, 2, 3, 5)]]
    spark.createDataFrame([(*r, 10.0, "A", "F") for r in gaps], kind).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("a07_unique", "a08_protein_by_file"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
