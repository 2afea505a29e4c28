"""mzML spectra as tables, and what is read off them: chromatograms, rasters, level counts.

Files are read by the built-in XML source, one spectrum a row; arrays are decoded in Arrow batches.
Columns that a query does not ask for are not decoded.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions import scalars as S
from spectraloom.functions.peaks import peaks_udf
from spectraloom.operators import joins

_PARAM = "array<struct<_accession:string,_name:string,_value:string,_unitName:string>>"
#: The parts of a spectrum element that are read.
SPECTRUM = f"""_id string, _index long, cvParam {_PARAM},
 scanList struct<scan:array<struct<cvParam:{_PARAM}>>>,
 precursorList struct<precursor:array<struct<_spectrumRef:string, isolationWindow:struct<cvParam:{_PARAM}>,
   selectedIonList:struct<selectedIon:array<struct<cvParam:{_PARAM}>>>, activation:struct<cvParam:{_PARAM}>>>>,
 binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_PARAM}, binary:string>>>"""
#: Accessions of the terms that are read.
LEVEL, CENTROID, PROFILE, RT = "MS:1000511", "MS:1000127", "MS:1000128", "MS:1000016"
TARGET, LOWER, UPPER, SELECTED, CHARGE, ENERGY = "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000744", "MS:1000041", "MS:1000045"
MZ_ARRAY, INTENSITY_ARRAY, FLOAT64, ZLIB = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574"


def _has(params: Column, accession: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == accession), F.lit(False))


def _term(params: Column, accession: str, field: str = "_value") -> Column:
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))[field]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode(binary: pd.Series, is_double: pd.Series, is_zlib: pd.Series) -> pd.Series:
    """Base64 of little-endian floats, perhaps deflated."""

    def one(text, wide, packed):
        if text is None:
            return None
        raw = base64.b64decode(text)
        return np.frombuffer(zlib.decompress(raw) if packed else raw, "<f8" if wide else "<f4").astype(float)

    return pd.Series([one(*x) for x in zip(binary, is_double, is_zlib)], dtype=object)


def _array(kind: str) -> Column:
    found = F.get(F.filter("binaryDataArrayList.binaryDataArray", lambda a: _has(a["cvParam"], kind)), F.lit(0))
    return decode(F.trim(found["binary"]), _has(found["cvParam"], FLOAT64), _has(found["cvParam"], ZLIB))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """A row a spectrum: file, id, scan number, level, kind, time in minutes, precursor fields, m/z and intensity arrays.

    The isolation window falls back to the selected ion, without width. Missing terms are null.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM).load(path).withColumn("_file", F.col("_metadata.file_path"))
    scan = F.get("scanList.scan", F.lit(0))["cvParam"]
    first = F.get("precursorList.precursor", F.lit(0))
    window, ion = first["isolationWindow"]["cvParam"], F.get(first["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    number = lambda p, a: _term(p, a).try_cast("double")
    rt = number(scan, RT) / F.when(_term(scan, RT, "_unitName") == "second", 60.0).otherwise(1.0)
    target = F.coalesce(number(window, TARGET), number(ion, SELECTED))
    kind = F.when(_has(F.col("cvParam"), CENTROID), "centroid").when(_has(F.col("cvParam"), PROFILE), "profile").otherwise("unknown")
    return raw.select(
        F.col("_file").alias("file"), F.col("_id").alias("spectrum_id"), F.col("_index").alias("spectrum_index"), S.scan_number(F.col("_id")).alias("scan_number"),
        _term(F.col("cvParam"), LEVEL).try_cast("int").alias("ms_level"), kind.alias("kind"), rt.alias("rt"),
        first["_spectrumRef"].alias("precursor_ref"), number(ion, SELECTED).alias("precursor_mz"), number(ion, CHARGE).cast("int").alias("precursor_charge"),
        (target - F.coalesce(number(window, LOWER), F.lit(0.0))).alias("isolation_low"), (target + F.coalesce(number(window, UPPER), F.lit(0.0))).alias("isolation_high"),
        number(first["activation"]["cvParam"], ENERGY).alias("collision_energy"), _array(MZ_ARRAY).alias("mz"), _array(INTENSITY_ARRAY).alias("intensity"),
    )


def same_length(spectra: DataFrame) -> DataFrame:
    """The spectra; one whose arrays differ in length fails the query."""
    odd = F.size("mz") != F.size("intensity")
    return spectra.withColumn("mz", F.when(odd, F.raise_error(F.concat(F.lit("arrays differ in length: "), F.col("spectrum_id")))).otherwise(F.col("mz")))


def ms1(spectra: DataFrame, least: float = 0.0) -> DataFrame:
    """MS1 spectra with a time: `scan` numbers them densely by file; points under the floor go; TIC and point count beside."""
    rows = same_length(spectra.where("ms_level = 1 AND rt IS NOT NULL"))
    # Numbers come from a narrow table; the arrays do not move for them beyond the join.
    number = F.row_number().over(W.partitionBy("file").orderBy("spectrum_index")) - 1
    numbered = rows.select("file", "spectrum_index").withColumn("scan", number.cast("long"))
    kept = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["intensity"] >= least)
    out = rows.join(numbered, ["file", "spectrum_index"]).withColumn("_p", kept)
    tic = F.aggregate("_p.intensity", F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"mz": F.col("_p.mz"), "intensity": F.col("_p.intensity"), "n_points": F.size("_p"), "tic": tic}).drop("_p")


def points(spectra: DataFrame) -> DataFrame:
    """A row a point: (file_id, scan, rt, mz, intensity)."""
    return spectra.select(F.col("file").alias("file_id"), "scan", "rt", F.inline(F.arrays_zip("mz", "intensity")))


def level_report(spectra: DataFrame) -> DataFrame:
    """Per file and level: counts of profile, centroid and unknown spectra, and the level's class."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    rows = spectra.groupBy("file", "ms_level").agg(n("profile"), n("centroid"), n("unknown"))
    kinds = sum((F.col(k) > 0).cast("int") for k in ("profile", "centroid", "unknown"))
    one = F.when(F.col("profile") > 0, "profile").when(F.col("centroid") > 0, "centroid").otherwise("unknown")
    return rows.withColumn("class", F.when(kinds == 0, "absent").when(kinds > 1, "mixed").otherwise(one))


def chromatograms(spectra: DataFrame, targets: list[float], ppm: float = 10.0, least: float = 0.01) -> DataFrame:
    """Per MS1 scan with peaks and target m/z, the intensity within the tolerance, 0 where none is."""
    pts = F.arrays_zip("mz", "intensity")

    def total(t: Column) -> Column:
        tol = S.ppm_tolerance(t, ppm, least)
        near = F.filter(pts, lambda p: (p["mz"] >= t - tol) & (p["mz"] <= t + tol))
        return F.aggregate(near, F.lit(0.0), lambda a, p: a + p["intensity"])

    wanted = F.array(*[F.lit(float(t)) for t in targets])
    return spectra.where(F.size("mz") > 0).select("file", "scan", "rt", F.inline(F.transform(wanted, lambda t: F.struct(t.alias("target"), total(t).alias("intensity")))))


def window(pts: DataFrame, mz: tuple[float, float], rt: tuple[float, float]) -> DataFrame:
    return pts.where(F.col("mz").between(*mz) & F.col("rt").between(*rt))


def raster(pts: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Largest intensity per scan and bin of m/z; the upper edge belongs to the last bin. Empty cells are left out."""
    at = F.least(F.floor((F.col("mz") - low) / ((high - low) / bins)), F.lit(bins - 1))
    return pts.where(F.col("mz").between(low, high)).groupBy("file_id", "scan", at.alias("bin")).agg(F.max("intensity").alias("intensity"))


def profile_raster(spectra: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Per scan, the intensities on an even grid of m/z by straight lines between points, 0 outside them."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def on_grid(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        grid = np.linspace(low, high, bins)

        def one(m, y):
            m, y = np.asarray(m, float), np.asarray(y, float)
            inside = (m >= low) & (m <= high)
            m, y = m[inside], y[inside]
            order = np.argsort(m, kind="stable")
            return np.interp(grid, m[order], y[order], left=0.0, right=0.0) if m.size else np.zeros(bins)

        return pd.Series([one(m, y) for m, y in zip(mz, intensity)], dtype=object)

    return spectra.select("file", "scan", "rt", on_grid("mz", "intensity").alias("row"))


def compare_kinds(profile: DataFrame, centroid: DataFrame) -> DataFrame:
    """Spectra of two versions of a file side by side by index: same level and time, and point counts."""
    a = profile.select("spectrum_index", F.struct("ms_level", "rt", F.size("mz").alias("n")).alias("p"))
    b = centroid.select("spectrum_index", F.struct("ms_level", "rt", F.size("mz").alias("n")).alias("c"))
    same = F.col("p.ms_level").eqNullSafe(F.col("c.ms_level")) & F.col("p.rt").eqNullSafe(F.col("c.rt"))
    return a.join(b, "spectrum_index", "full_outer").select("spectrum_index", F.col("p.n").alias("profile_points"), F.col("c.n").alias("centroid_points"), same.alias("agree"))


def preceding_ms1(spectra: DataFrame) -> DataFrame:
    """Each MS2 spectrum with the last MS1 before it in its file."""
    before = W.partitionBy("file").orderBy("spectrum_index").rowsBetween(W.unboundedPreceding, 0)
    return spectra.withColumn("ms1_index", F.last(F.when(F.col("ms_level") == 1, F.col("spectrum_index")), ignorenulls=True).over(before)).where("ms_level = 2")


def ms2_on(spectra: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, spectrum): MS2 spectra whose isolation window overlaps a box's m/z and whose time lies in it.

    Boxes are filed by whole minutes of their time, so the join is on equality.
    """
    filed = boxes.withColumn("_m", F.explode(F.sequence(F.floor("rt_start"), F.floor("rt_end"))))
    s = spectra.where("ms_level = 2").select("file", "spectrum_id", "rt", "isolation_low", "isolation_high", F.floor("rt").alias("_m"))
    hit = F.col("rt").between(F.col("rt_start"), F.col("rt_end")) & (F.col("isolation_low") <= F.col("mz_max")) & (F.col("isolation_high") >= F.col("mz_min"))
    return filed.join(s, ["file", "_m"]).where(hit).select("box_id", "file", "spectrum_id", "rt")


def profile_points(spectra: DataFrame, boxes: DataFrame) -> DataFrame:
    """Profile points that lie under a peak whose top is in a box: (file, scan, rt, mz, intensity, box_id), the best box by quality.

    Points are cut into peaks scan by scan, and a whole peak, bounds included, follows its top; a valley between
    two peaks may come with both. `boxes` is (file, box_id, mz_min, mz_max, rt_start, rt_end, quality); of equal ones the least id.
    """
    rows = same_length(spectra).where(F.size("mz") > 0)
    pts = F.array_sort(F.arrays_zip("mz", "intensity"))
    rows = rows.select("file", "scan", "rt", pts.alias("p")).withColumn("peak", F.explode(peaks_udf()(F.col("p.intensity"))))
    under = F.slice("p", F.col("peak.left") + 1, F.col("peak.right") - F.col("peak.left"))
    tops = rows.select("file", "scan", "rt", F.get("p", F.col("peak.apex"))["mz"].alias("top"), "peak.left", under.alias("p"))
    filed = boxes.withColumnRenamed("file", "_file")
    met = joins.points_in_boxes(tops, filed, "file", "_file", ("rt", "rt_start", "rt_end"), ("top", "mz_min", "mz_max"), 1.0, ["file", "scan", "left"], [F.desc("quality"), F.asc("box_id")])
    return met.select("file", "scan", "rt", F.inline("p"), "box_id").distinct()
