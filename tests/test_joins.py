from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.operators import joins
from spectraloom.plans import registry


def test_band_join_bounds(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "l int, x double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.5), (3, 9.0)], "r int, y double")
    assert sorted(map(tuple, joins.band_join(a, b, "x", "y", 0.5).select("l", "r").collect())) == [(1, 1), (2, 1), (2, 2)]
    assert joins.band_join(a, b, "x", "y", 0.5, strict=True).count() == 0


def test_nearest_join_keeps_ties(spark):
    a = spark.createDataFrame([(1, 5.0)], "l int, x double")
    b = spark.createDataFrame([(1, 4.0), (2, 6.0), (3, 7.5)], "r int, y double")
    assert {r.r for r in joins.nearest_join(a, b, "l", "x", "y", 3.0).collect()} == {1, 2}


def test_overlap_join_once(spark):
    a = spark.createDataFrame([("k", 0.0, 10.0)], "k string, l0 double, l1 double")
    b = spark.createDataFrame([("k", 1.0, 9.0), ("k", 10.0, 11.0)], "k string, r0 double, r1 double")
    assert joins.overlap_join(a, b, "k", "l0", "l1", "r0", "r1", 1.0).count() == 1


def test_peptide_text(spark):
    rows = spark.createDataFrame([("K.PEP[+15.99]T.R",), ("PEP(ox)tU",), ("A.B",)], "p string")
    got = rows.select(S.strip_mods(S.strip_flanks(F.col("p"))), S.plain_sequence(S.strip_flanks(F.col("p"))), S.mod_mass(F.col("p")), S.left_flank(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("PEPT", "PEPT", 15.99, "K"), ("PEPU", "PEPTU", 0.0, ""), ("AB", "AB", 0.0, "")]


def test_lists_and_sites(spark):
    row = spark.createDataFrame([("decoy_A;B, C", "AKPRKG", " ")], "a string, s string, n string")
    got = row.select(S.items(F.col("a")), S.is_decoy(F.col("a")), S.cleavage_sites(F.col("s")), S.to_double(F.col("n"))).first()
    assert tuple(got) == (["decoy_A", "B", "C"], True, [4, 5], None)


def test_every_event_has_a_box(spark, tmp_path):
    rows = [(i, 1 + i // 20, 10.0 * (i % 20), "2024-01-01 00:00:00") for i in range(1, 60)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("j27_point_in_box_whole") == {(i, i) for i in range(1, 60)} and not run("j26_box_overlap_whole")
    assert run("a28_point_class_whole") == {(i, 0 if v > 60 else 1 if v > 30 else 2) for i, _, v, _ in rows}


def test_candidates_of_later_customers(spark, tmp_path):
    rows = [(1, 5_000_000, "O", 150000.0, "1998-01-01", "1-URGENT"), (2, 10, "O", 150000.0, "2000-01-01", "1-URGENT")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.o_orderkey for r in registry.QUERIES["j29_candidates_whole"](spark, str(tmp_path)).collect()] == [1]
