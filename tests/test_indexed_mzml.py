"""Indexed mzML through the data source: equal to the XML reader's rows, in several tasks, with filters that reach it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.sources import indexed_mzml as I
from spectraloom.sources import mzml_out, spectra

FIELDS = "run string, spectrum_id string, spectrum_index long, ms_level int, kind string, rt double, precursor_ref string, precursor_mz double, precursor_charge int, isolation_low double, isolation_high double, collision_energy double, mz array<double>, intensity array<double>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out, rng = str(tmp_path_factory.mktemp("runs")), np.random.default_rng(2)
    rows = []
    for run in ("a", "b é"):
        for i in range(120):
            n = int(rng.integers(0, 60))
            mz = sorted(map(float, rng.uniform(100, 900, n)))
            two = i % 3 == 1
            rows.append((run, f'controller="{run}" scan={i * 2}', i, 2 if two else 1, ["centroid", "profile", None][i % 3], None if i % 17 == 0 else i * 0.05, "ref & <x>" if two else None, 500.25 if two else None, 2 if i % 6 == 1 else None, 499.5 if two else None, 501.0 if two else None, 27.0 if two else None, mz, mz))
    mzml_out.write_mzml(spark.createDataFrame(rows, FIELDS), out).collect()
    spark.dataSource.register(I.IndexedMzml)
    return out


@pytest.fixture
def pushing(spark):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield spark
    spark.conf.set(name, before)


def rows(df):
    names = [c for c in df.columns if c != "file"]
    return sorted(map(str, df.select(F.regexp_extract("file", "([^/]*)$", 1).alias("f"), *names).withColumn("f", F.regexp_replace("f", "%20", " ")).withColumn("f", F.substring("f", 1, 1)).collect()))


def test_equal_to_the_xml_reader_in_many_tasks(pushing, folder):
    spark = pushing
    whole = spark.read.format("indexed_mzml").option("task_bytes", 20_000).load(folder)
    assert rows(whole) == rows(spectra.read_mzml(spark, f"{folder}/*.mzML")) and whole.count() == 240
    assert whole.rdd.getNumPartitions() > 6
    assert spark.read.format("indexed_mzml").load(f"{folder}/a.mz*").count() == 120
    bare = spark.read.format("indexed_mzml").option("arrays", "false").load(f"{folder}/a.mzML")
    assert bare.where("mz IS NOT NULL").count() == 0 and bare.where("ms_level = 2").count() == 40


def test_filters_reach_the_reader(pushing, folder):
    whole = pushing.read.format("indexed_mzml").option("task_bytes", 20_000).load(folder)
    every = [r.asDict() for r in whole.collect()]
    cases = {"spectrum_id = 'controller=\"a\" scan=34'": lambda r: r["spectrum_id"] == 'controller="a" scan=34', "spectrum_index IN (3, 119, 500)": lambda r: r["spectrum_index"] in (3, 119),
             "ms_level = 2 AND rt >= 1.0 AND rt < 3.05": lambda r: r["ms_level"] == 2 and r["rt"] is not None and 1.0 <= r["rt"] < 3.05, "rt > 5.5 AND kind = 'profile'": lambda r: r["rt"] is not None and r["rt"] > 5.5 and r["kind"] == "profile"}
    for where, keeps in cases.items():
        got = whole.where(where)
        assert sorted(str(r) for r in got.collect()) == sorted(str(r) for r in whole.collect() if keeps(r.asDict())) and any(map(keeps, every))
    one = whole.where("spectrum_id = 'controller=\"a\" scan=34'")
    assert one.rdd.getNumPartitions() == 1
    # Spark keeps no filter of its own on what the reader took.
    plan = whole.where("ms_level = 2 AND rt >= 1.0")._jdf.queryExecution().executedPlan().toString()
    assert "ms_level" not in "".join(x for x in plan.split("\n") if "Filter" in x and "BatchScan" not in x).replace("isnotnull(ms_level", "")


def test_reader_reads_the_bytes_of_the_spectra_alone(folder):
    reader = I.Reader({"path": f"{folder}/a.mzML"})
    left = list(reader.pushFilters([I.In(("spectrum_index",), (5, 7)), I.EqualTo(("ms_level",), 1), I.EqualTo(("kind",), "profile")]))
    assert [f.attribute for f in left] == [("kind",)]
    (span,) = reader.partitions()
    names, at = I.offsets(f"{folder}/a.mzML")
    assert span.ranges == ((at[5], at[6]), (at[7], at[8]))
    got = [r for b in reader.read(span) for r in b.to_pylist()]
    assert [r["spectrum_id"] for r in got] == [names[5]]  # the other one is of level 2


def test_files_without_an_index_are_refused(spark, tmp_path):
    (tmp_path / "x.mzML").write_text("<mzML></mzML>")
    with pytest.raises(ValueError, match="no index"):
        I.offsets(str(tmp_path / "x.mzML"))
