import math
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.sources import mzml_out, spectra, sqlite


def test_sqlite_round_trip(spark, tmp_path):
    features = spark.createDataFrame([("a", 1, 500.25, "x'\"y"), ("a", 2, float("nan"), None), ("b", 1, 1e-300, "")], "file_id string, feature_id long, mz double, note string")
    scans = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.6)], "file_id string, ms1_index long, rt double")
    points = spark.createDataFrame([("a", 0, [1.5, 2.5], [3.0, 4.0])], "file_id string, ms1_index long, mz array<double>, intensity array<double>")
    parameters = spark.createDataFrame([("a", "ppm", "10")], "file_id string, key string, value string")
    tables = {"features": features, "scans": scans, "scan_points": points, "parameters": parameters}
    made = sqlite.write_stores(tables, f"{tmp_path}/out", index={"features": ["mz"]}).collect()
    assert {(r.file_id, r.rows) for r in made} == {("a", 6), ("b", 1)}
    con = sqlite3.connect(f"{tmp_path}/out/a.sqlite")
    assert con.execute("SELECT * FROM features ORDER BY feature_id").fetchall() == [(1, 500.25, "x'\"y"), (2, None, None)]
    assert con.execute("SELECT name FROM sqlite_master WHERE type = 'index'").fetchall() == [("features_mz",)]
    assert np.frombuffer(zlib.decompress(con.execute("SELECT mz FROM scan_points").fetchone()[0]), "<f4").tolist() == [1.5, 2.5]
    where = f"{tmp_path}/out/*.sqlite"
    got = {(r.file[-8:], r.feature_id, r.mz, r.note) for r in sqlite.read_table(spark, where, "features", "feature_id long, mz double, note string").collect()}
    assert got == {("a.sqlite", 1, 500.25, "x'\"y"), ("a.sqlite", 2, None, None), ("b.sqlite", 1, 1e-300, "")}
    assert [(r.scan, r.rt, r.mz, r.intensity) for r in sqlite.read_points(spark, where).orderBy("scan").collect()] == [(0, 0.5, [1.5, 2.5], [3.0, 4.0]), (1, 0.6, None, None)]
    assert [tuple(r)[1:] for r in sqlite.read_parameters(spark, where).collect()] == [("ppm", "10")]
    assert sqlite.read_table(spark, where, "missing", "a long").count() == 0


def test_rows_without_a_file_fail(spark, tmp_path):
    with pytest.raises(Exception, match="has no file_id"):
        sqlite.write_stores({"t": spark.createDataFrame([(None, 1)], "file_id string, a long")}, f"{tmp_path}/out").collect()


SPECTRUM = "run string, spectrum_id string, spectrum_index long, ms_level int, kind string, rt double, precursor_ref string, precursor_mz double, precursor_charge int, isolation_low double, isolation_high double, collision_energy double, mz array<double>, intensity array<double>"


def test_mzml_round_trip(spark, tmp_path):
    rows = [
        ("r1", "scan=2 <&>", 1, 2, "centroid", 0.25, "scan=1", 500.1, 2, 499.5, 501.0, 27.0, [100.125, 1 / 3], [1.0, 2.0]),
        ("r1", "scan=1", 0, 1, "profile", 0.1, None, None, None, None, None, None, [400.0, 401.0], [5.0, 0.0]),
        ("r2", "scan=9", 8, 1, "unknown", None, None, None, None, None, None, None, [], []),
    ]
    made = mzml_out.write_mzml(spark.createDataFrame(rows, SPECTRUM), f"{tmp_path}/out").collect()
    assert {(r.run, r.spectra) for r in made} == {("r1", 2), ("r2", 1)}
    back = spectra.read_mzml(spark, f"{tmp_path}/out/*.mzML").withColumn("run", F.regexp_extract("file", r"(\w+)\.mzML$", 1)).orderBy("run", "spectrum_index").collect()
    assert [(r.run, r.spectrum_id, r.spectrum_index) for r in back] == [("r1", "scan=1", 0), ("r1", "scan=2 <&>", 1), ("r2", "scan=9", 0)]
    for r, want in zip(back, (rows[1], rows[0], rows[2])):
        names = ["ms_level", "kind", "rt", "precursor_ref", "precursor_mz", "precursor_charge", "isolation_low", "isolation_high", "collision_energy"]
        for name, w in zip(names, want[3:12]):
            assert r[name] == w or (isinstance(w, float) and math.isclose(r[name], w, rel_tol=1e-12)), name
        assert (r.mz or []) == want[12] and (r.intensity or []) == want[13]


def test_odd_arrays_leave_no_file(spark, tmp_path):
    odd = spark.createDataFrame([("r", "s", 0, 1, "profile", 0.1, None, None, None, None, None, None, [1.0], [])], SPECTRUM)
    with pytest.raises(Exception, match="differ in length"):
        mzml_out.write_mzml(odd, f"{tmp_path}/out").collect()
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")]


def test_profile_points_follow_their_top(spark):
    y = [0.0, 1.0, 5.0, 1.0, 0.0, 2.0, 9.0, 2.0, 0.0]
    mz = [500 + 0.01 * i for i in range(9)]
    s = spark.createDataFrame([("f", "s0", 0, 0.5, mz, y), ("f", "s1", 1, 3.5, mz, y)], "file string, spectrum_id string, scan int, rt double, mz array<double>, intensity array<double>")
    boxes = spark.createDataFrame([("f", 1, 500.015, 500.025, 0.0, 1.0, 0.5), ("f", 2, 500.0, 500.1, 0.2, 0.9, 0.4), ("g", 3, 0.0, 1e3, 0.0, 9.0, 1.0)], "file string, box_id int, mz_min double, mz_max double, rt_start double, rt_end double, quality double")
    got = {(r.box_id, round((r.mz - 500) * 100)) for r in spectra.profile_points(s, boxes).collect()}
    assert got == {(1, i) for i in range(5)} | {(2, i) for i in range(4, 9)}
