"""Column functions for search results, peptides and masses. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses in dalton.
PROTON, C13_STEP, WATER = 1.007276554940804, 1.00335483507, 18.0105646863
AVERAGINE_LAMBDA = 0.000594


def to_double(x: Column) -> Column:
    """Blank or malformed text is null."""
    return F.nullif(F.trim(x), F.lit("")).try_cast("double")


def to_int(x: Column) -> Column:
    return to_double(x).cast("long")


def items(x: Column, separators: str = "[;, ]+") -> Column:
    """Trimmed non-blank parts of a list in text."""
    return F.filter(F.transform(F.split(x, separators), lambda p: F.trim(p)), lambda p: p != "")


def is_decoy(proteins: Column, tag: str = "decoy_") -> Column:
    return F.exists(items(proteins), lambda p: F.startswith(p, F.lit(tag)))


def keep_q(q: Column, most: float) -> Column:
    """Null q-values are dropped; the bound is inclusive."""
    return F.coalesce(to_double(q) <= most, F.lit(False))


def _flanked(p: Column) -> Column:
    return (F.length(p) >= 5) & (F.substring(p, 2, 1) == ".") & (F.substr(p, F.length(p) - 1, F.lit(1)) == ".")


def strip_flanks(p: Column) -> Column:
    """`K.PEPTIDE.R` without its flanks; other text as it is."""
    return F.when(_flanked(p), F.substr(p, F.lit(3), F.length(p) - 4)).otherwise(p)


def left_flank(p: Column) -> Column:
    return F.when(_flanked(p), F.substring(p, 1, 1)).otherwise("")


def right_flank(p: Column) -> Column:
    return F.when(_flanked(p), F.substr(p, F.length(p), F.lit(1))).otherwise("")


def strip_mods(p: Column) -> Column:
    """Residues A-Z alone, after bracketed modifications are gone."""
    for brackets in (r"\[[^\]]*\]", r"\([^)]*\)", r"\{[^}]*\}", "[^A-Z]"):
        p = F.regexp_replace(p, brackets, "")
    return p


def plain_sequence(p: Column) -> Column:
    """Residues of a bare or modified peptide, lower case counted as upper."""
    for brackets in (r"\[[^\]]*\]", r"\([^)]*\)", r"\{[^}]*\}", "[^A-Za-z]"):
        p = F.regexp_replace(p, brackets, "")
    return F.upper(p)


def mod_mass(p: Column) -> Column:
    """Sum of the first signed number in each square bracket."""
    found = F.regexp_extract_all(p, F.lit(r"\[([+-]?[0-9]+\.?[0-9]*)"), F.lit(1))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def scan_number(native: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(native, r"scan=(\d+)", 1), F.lit("")), native)


def safe_dir_name(filename: Column) -> Column:
    """A run's folder: the name without its spectrum suffix, odd characters as underscores."""
    return F.regexp_replace(F.regexp_replace(filename, r"(\.centroid)?\.mz(ML|ml)$", ""), "[^A-Za-z0-9_.-]+", "_")


def scan_key(filename: Column, scan: Column) -> Column:
    return F.concat(filename, F.lit(":scan="), scan)


def fraction_name(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit("_GuHCl_")), "GuHCl").when(F.contains(filename, F.lit("_NaCl_")), "NaCl").otherwise("")


def replicate_name(filename: Column) -> Column:
    return F.regexp_extract(filename, r"_(\d+)(?:_|\.centroid)", 1)


def join_unique(values: Column) -> Column:
    """Distinct non-blank values, whole numbers first by size, joined by semicolons."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    number = lambda v: F.when(v.rlike("^[0-9]+$"), v.try_cast("decimal(38,0)"))
    keyed = F.transform(kept, lambda v: F.struct(number(v).isNull().alias("text"), number(v).alias("number"), v.alias("value")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s.value), ";")


def ppm_tolerance(mz: Column, ppm: float, least: float) -> Column:
    return F.greatest(F.lit(least), mz * ppm / 1e6)


def neutral_mass(mz: Column, charge: Column) -> Column:
    return (mz - PROTON) * charge


def isotope_mzs(mass: Column, charge: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: mass / charge + PROTON + i * C13_STEP / charge)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two intervals, 0 where they do not meet."""
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / union).otherwise(0.0)


def intensity_score(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 1 - F.least(F.lit(1.0), F.abs(F.log2(a / b)) / 4)).otherwise(0.0)


def cleavage_sites(sequence: Column) -> Column:
    """Positions after K or R that no P follows, ends excluded."""
    n = F.length(sequence)
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: F.substr(sequence, i, F.lit(1)).isin("K", "R") & (F.substr(sequence, i + 1, F.lit(1)) != "P"))


def wrap_fasta(sequence: Column, width: int = 60) -> Column:
    return F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))


def mz_of(mass: Column, charge: Column) -> Column:
    """The m/z of a neutral mass: the inverse of `neutral_mass`."""
    return (mass + charge * PROTON) / charge


def measured_mass(calculated: Column, experimental: Column) -> Column:
    """The first of two texts that is a positive number, else null."""
    each = [to_double(x) for x in (calculated, experimental)]
    return F.coalesce(*[F.when(x > 0, x) for x in each])


def measured_charge(charge: Column) -> Column:
    """A positive whole charge, else null."""
    z = to_int(charge)
    return F.when(z > 0, z)


def measured_time(rt: Column, aligned: Column) -> Column:
    """The first of two texts that is a number, else null."""
    return F.coalesce(to_double(rt), to_double(aligned))


#: Q-values between which the colour scale runs, and the least that is told apart.
Q_BEST, Q_WORST, Q_LEAST = 1e-4, 0.05, 1e-6


def q_position(q: Column, linear: bool = False) -> Column:
    """Place of a q-value on a scale from 0 (best, and null) to 1: even in its logarithm, or in itself from 0."""
    x = F.greatest(q, F.lit(Q_LEAST))
    t = x / Q_WORST if linear else F.log10(x / Q_BEST) / F.log10(F.lit(Q_WORST / Q_BEST))
    return F.when(q.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def heat(t: Column) -> Column:
    """(red, green, blue) of a place on the scale: green over yellow to red."""
    part = lambda x: F.floor(255 * F.least(F.lit(1.0), 2 * x)).cast("int")
    return F.struct(part(t).alias("red"), part(1 - t).alias("green"), F.lit(40).alias("blue"))


def levels(text: Column) -> Column:
    """Sorted distinct numbers of a list such as `1,2-4`; blank parts are skipped, other text is an error, as is a list without any."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-", 2), lambda x: F.trim(x).cast("int"))
    run = lambda e: F.when(e[0] <= F.element_at(e, -1), F.sequence(e[0], F.element_at(e, -1))).otherwise(F.array().cast("array<int>"))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(parts, ends), run))))
    return F.when(text.isNull() | (F.size(found) > 0), found).otherwise(F.raise_error(F.lit("no levels are named")))


def is_mzml(path: Column) -> Column:
    return F.lower(path).rlike(r"\.mzml(\.gz)?$")


def is_centroid_mzml(path: Column) -> Column:
    return F.lower(path).rlike(r"\.centroid\.mzml(\.gz)?$")
