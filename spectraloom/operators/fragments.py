"""Fragment ions against spectra: nearest peaks, best peaks, what is left over, and how well they cover a peptide.

Ions are rows of (spectrum, ion, place, charge, mz) with an optional `isotope`; peaks of (spectrum, peak_mz, intensity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as C
from spectraloom.operators import joins

LABEL = ["ion", "place", "charge"]


def ion_rows(peptides: DataFrame, *keys: str, sequence: str = "sequence", charges: tuple[int, ...] = (1, 2), ions: str = "by") -> DataFrame:
    """(keys, ion, place, charge, mz): the theoretical ions of each peptide; none for fewer than two residues."""
    return peptides.select(*keys, F.inline(C.fragments(F.col(sequence), charges, ions)))


def _isotopes(ions: DataFrame) -> Column:
    return F.array_sort(F.collect_set("isotope" if "isotope" in ions.columns else F.lit(0)))


def annotate(ions: DataFrame, peaks: DataFrame, ppm: float = 20.0) -> DataFrame:
    """(spectrum, peak_mz, intensity, ion, place, charge, theo_mz, isotopes, error, place_in_peak): what each hit peak may be.

    An ion goes to the nearest peak strictly within the tolerance, to both where two are as near. Ions of one label whose
    m/z agree to four digits are one row with all their isotopes. Rows of a peak are numbered by falling size of the error.
    """
    # Peptides of one spectrum share ions: each is compared once.
    own = ["spectrum", *LABEL, "mz", *[c for c in ("isotope",) if c in ions.columns]]
    met = joins.nearest_ppm(ions.select(*own).distinct(), peaks, own, "mz", "peak_mz", ppm, ["spectrum"])
    rows = met.groupBy("spectrum", "peak_mz", "intensity", *LABEL, F.round("mz", 4).alias("_m")).agg(F.min("mz").alias("theo_mz"), _isotopes(ions).alias("isotopes"))
    error = (F.col("peak_mz") - F.col("theo_mz")) / F.col("theo_mz") * 1e6
    by = W.partitionBy("spectrum", "peak_mz", "intensity").orderBy(F.desc(F.abs("error")), *LABEL)
    return rows.drop("_m").withColumn("error", error).withColumn("place_in_peak", F.row_number().over(by))


def unmatched(peaks: DataFrame, annotated: DataFrame) -> DataFrame:
    """Peaks that no ion came to."""
    return peaks.join(annotated.select("spectrum", "peak_mz").hint("merge"), ["spectrum", "peak_mz"], "left_anti")


def best_peaks(ions: DataFrame, peaks: DataFrame, ppm: float = 20.0) -> DataFrame:
    """(spectrum, ion, place, charge, theo_mz, isotopes, matched, mz, intensity): each ion with the strongest peak within the tolerance.

    Ions of one label whose m/z agree to three digits are one; an ion without a peak keeps its own m/z and no intensity.
    """
    each = ions.groupBy("spectrum", *LABEL, F.round("mz", 3).alias("_m")).agg(F.min("mz").alias("theo_mz"), _isotopes(ions).alias("isotopes"))
    met = joins.ppm_join(each.select("spectrum", *LABEL, "_m", "theo_mz"), peaks, "theo_mz", "peak_mz", ppm, ["spectrum"])
    best = met.groupBy("spectrum", *LABEL, "_m").agg(F.max(F.struct("intensity", (-F.col("peak_mz")).alias("_n"))).alias("_b"))
    out = each.join(best.hint("merge"), ["spectrum", *LABEL, "_m"], "left")
    hit = F.col("_b").isNotNull()
    return out.select("spectrum", *LABEL, "theo_mz", "isotopes", hit.alias("matched"), F.coalesce(-F.col("_b._n"), "theo_mz").alias("mz"), F.coalesce("_b.intensity", F.lit(0.0)).alias("intensity"))


def matched_labels(ions: DataFrame, peaks: DataFrame, ppm: float, *keys: str) -> DataFrame:
    """(keys, labels): the distinct (ion, place) of which some charge lies within the tolerance (inclusive) of a peak."""
    # A spectrum's m/z are compared once, however many peptides have them.
    hit = joins.ppm_join(ions.select("spectrum", "mz").distinct(), peaks, "mz", "peak_mz", ppm, ["spectrum"]).select("spectrum", "mz").distinct()
    met = ions.join(hit.hint("merge"), ["spectrum", "mz"], "left_semi").select(*keys, "ion", "place").distinct()
    return met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ion", "place"))).alias("labels"))


def coverage(sequence: Column, labels: Column) -> Column:
    """Struct of divider, segments (text, covers), covered residues, n_segments, the three weights, score and match_counts.

    An ion from the front covers what lies before its cut, one from the back what lies behind. A segment between two cuts is covered
    by the front ions that end behind its start and the back ions that begin at or before it. The score is one over the number of covered
    segments, times one over each one's length and the peptide's, times one over the longest front and back ion together. All 0 without labels.
    """
    n = F.length(sequence)
    front = F.transform(F.filter(labels, lambda x: x.ion.isin(*C.N_IONS)), lambda x: x.place)
    back = F.transform(F.filter(labels, lambda x: x.ion.isin(*C.C_IONS)), lambda x: n - x.place)
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(front, back), lambda c: (c > 0) & (c < n))))
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(n))
    covers = lambda a: F.size(F.filter(front, lambda p: p > a)) + F.size(F.filter(back, lambda c: c <= a))
    segments = F.zip_with(starts, ends, lambda a, b: F.struct(F.substr(sequence, a + 1, b - a).alias("text"), covers(a).alias("covers")))
    kept = F.filter(segments, lambda s: s.covers > 0)
    longest_front, first_back = F.coalesce(F.array_max(front), F.lit(0)), F.coalesce(F.array_min(back), n)
    reach = longest_front + (n - first_back)
    any_ = (F.size(labels) > 0) & (reach > 0)
    isolation = F.aggregate(kept, F.lit(1.0), lambda a, s: a / F.length(s.text) / n)
    zero = lambda x: F.when(any_, x).otherwise(0)
    weights = {"divider_weight": 1.0 / F.size(kept), "isolation_weight": isolation, "coverage_weight": 1.0 / reach}
    score = weights["divider_weight"] * weights["isolation_weight"] * weights["coverage_weight"]
    counts = F.size(F.array_distinct(labels)) + F.aggregate(kept, F.lit(0), lambda a, s: a + F.length(s.text) * s.covers)
    return F.struct(
        F.when(any_, C.coverage_string(sequence, cuts)).otherwise("").alias("divider"), segments.alias("segments"), zero(n - F.greatest(F.lit(0), first_back - longest_front)).alias("covered"),
        zero(F.size(kept)).alias("n_segments"), *[zero(w).alias(k) for k, w in weights.items()], zero(score).alias("score"), zero(counts).alias("match_counts"),
    )


def report(candidates: DataFrame, peaks: DataFrame, ppm: float = 20.0, charges: tuple[int, ...] = (1, 2), ions: str = "by") -> DataFrame:
    """Candidates (candidate_id, spectrum, sequence) with `n_ions` and their coverage; those without a match stay, with zeros."""
    key = ["spectrum", "sequence"]
    # A peptide of a spectrum is looked at once, however many candidates state it.
    each = candidates.select(*key).distinct()
    labels = matched_labels(ion_rows(each, *key, charges=charges, ions=ions), peaks, ppm, *key)
    rows = each.join(labels.hint("merge"), key, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<ion:string,place:int>>")))
    # The coverage is worked out once: its parts are looked up by name.
    rows = rows.withColumn("_c", F.get(F.transform(F.array(F.struct(F.col("sequence").alias("s"), F.col("labels").alias("l"))), lambda x: coverage(x.s, x.l)), F.lit(0))).select(*key, F.size("labels").alias("n_ions"), "labels", "_c.*")
    named = candidates.withColumnsRenamed({k: f"_{k}" for k in key})
    met = named.join(rows.hint("merge"), F.col("_spectrum").eqNullSafe(F.col("spectrum")) & F.col("_sequence").eqNullSafe(F.col("sequence")))
    return met.select("candidate_id", "spectrum", "sequence", *[c for c in rows.columns if c not in key])
