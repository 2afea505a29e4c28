"""Masses, compositions, fragments and digestion as column functions; isotope patterns in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.scalars import AVERAGINE_LAMBDA, C13_STEP, PROTON

#: Isotopes (mass, abundance) of the elements, lightest first.
ISOTOPES = {
    "H": [(1.00782503223, 0.999885), (2.01410177812, 0.000115)],
    "C": [(12.0, 0.9893), (13.00335483507, 0.0107)],
    "N": [(14.00307400443, 0.99636), (15.00010889888, 0.00364)],
    "O": [(15.99491461957, 0.99757), (16.99913175650, 0.00038), (17.99915961286, 0.00205)],
    "S": [(31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425), (35.96708071, 0.0001)],
    "P": [(30.97376199842, 1.0)],
    "Se": [(73.922475934, 0.0089), (75.919213704, 0.0937), (76.919914154, 0.0763), (77.91730928, 0.2377), (79.9165218, 0.4961), (81.9166995, 0.0873)],
}
ELEMENTS = ["C", "H", "N", "O", "S", "Se", "P"]
#: Atoms (C, H, N, O, S, Se) of residues.
RESIDUES = {
    "A": (3, 5, 1, 1, 0, 0), "R": (6, 12, 4, 1, 0, 0), "N": (4, 6, 2, 2, 0, 0), "D": (4, 5, 1, 3, 0, 0), "C": (3, 5, 1, 1, 1, 0),
    "Q": (5, 8, 2, 2, 0, 0), "E": (5, 7, 1, 3, 0, 0), "G": (2, 3, 1, 1, 0, 0), "H": (6, 7, 3, 1, 0, 0), "I": (6, 11, 1, 1, 0, 0),
    "L": (6, 11, 1, 1, 0, 0), "K": (6, 12, 2, 1, 0, 0), "M": (5, 9, 1, 1, 1, 0), "F": (9, 9, 1, 1, 0, 0), "P": (5, 7, 1, 1, 0, 0),
    "S": (3, 5, 1, 2, 0, 0), "T": (4, 7, 1, 2, 0, 0), "W": (11, 10, 2, 1, 0, 0), "Y": (9, 9, 1, 2, 0, 0), "V": (5, 9, 1, 1, 0, 0),
    "U": (3, 5, 1, 1, 0, 1), "O": (12, 19, 3, 2, 0, 0), "J": (6, 11, 1, 1, 0, 0),
}
#: What an ion has beside its residues (C, H, N, O), ions of the N-terminus first.
N_IONS = {"a": (-1, 0, 0, -1), "b": (0, 0, 0, 0), "c": (0, 3, 1, 0)}
C_IONS = {"x": (1, 0, 0, 2), "y": (0, 2, 0, 1), "z": (0, -1, -1, 1)}
#: Atoms of the average residue and its mass.
AVERAGINE, AVERAGINE_MASS = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}, 111.1254


def _light(atoms: tuple) -> float:
    return sum(n * ISOTOPES[e][0][0] for e, n in zip(ELEMENTS, atoms))


PATTERN = T.ArrayType(T.StructType([T.StructField("mass", T.DoubleType()), T.StructField("abundance", T.DoubleType())]))
RESIDUE_MASS = {r: _light(a) for r, a in RESIDUES.items()}
WATER_MASS = _light((0, 2, 0, 1))


def _literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def residue_masses(sequence: Column) -> Column:
    """Mass of every residue; null for a letter that is none."""
    return F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), lambda c: F.try_element_at(_literal(RESIDUE_MASS), c))


def peptide_mass(sequence: Column) -> Column:
    """Monoisotopic neutral mass with one water; null where a letter is no residue."""
    return F.aggregate(residue_masses(sequence), F.lit(WATER_MASS), lambda a, m: a + m)


def composition(sequence: Column) -> Column:
    """Atoms as a struct by element, water included; null where a letter is no residue."""
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    total = lambda i, start: F.aggregate(letters, F.lit(start), lambda a, c: a + F.try_element_at(_literal({r: x[i] for r, x in RESIDUES.items()}), c))
    return F.struct(*[total(i, {"H": 2, "O": 1}.get(e, 0)).alias(e) for i, e in enumerate(ELEMENTS[:6])])


def averagine_composition(mass: Column) -> Column:
    """Atoms of the average peptide of a mass, water added; carbons at least 1. Halves round to even."""
    units = F.greatest(F.lit(1.0), mass / AVERAGINE_MASS)
    n = {e: F.bround(units * per).cast("int") for e, per in AVERAGINE.items()}
    n["C"] = F.greatest(n["C"], F.lit(1))
    n["H"], n["O"] = n["H"] + 2, n["O"] + 1
    return F.struct(*[x.alias(e) for e, x in n.items()])


def averagine_envelope(mass: Column, n: int) -> Column:
    """n Poisson weights of the averagine model, the largest 1."""
    rate = F.greatest(mass, F.lit(1.0)) * AVERAGINE_LAMBDA
    logs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * F.ln(rate) - F.ln(F.factorial(k).cast("double")) if n <= 21 else k * F.ln(rate))
    return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))


def fragments(sequence: Column, charges: tuple[int, ...] = (1, 2), ions: str = "by") -> Column:
    """Array of (ion, place, charge, mz): prefixes and suffixes of the residues, none for fewer than two."""
    masses, n = residue_masses(sequence), F.length(sequence)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, m: a + m)

    def ladder(ion: str, z: int, extra: float):
        def row(k: Column) -> Column:
            part = F.slice(masses, F.lit(1), k) if ion in N_IONS else F.slice(masses, n - k + 1, k)
            return F.struct(F.lit(ion).alias("ion"), k.alias("place"), F.lit(z).alias("charge"), ((total(part) + extra + PROTON * z) / z).alias("mz"))

        return row

    kinds = []
    for ion in ions:
        for z in charges:
            kinds.append(F.transform(steps, ladder(ion, z, _light(N_IONS.get(ion) or C_IONS[ion]))))
    return F.concat(*kinds)


def cut_sites(sequence: Column) -> Column:
    """0, every place after K or R that no P follows, and the length. Pieces are cut once, not looked up by place."""
    lengths = F.transform(F.split(sequence, "(?<=[KR])(?=[^P])"), F.length)
    run = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.when(F.length(sequence) > 0, run).otherwise(F.array().cast("array<int>"))


#: Trypsin: behind K or R, but not before P.
TRYPSIN = "(?<=[KR])(?=[^P])"


def cutting(cutters: dict[str, tuple[str, ...]]) -> str:
    """A pattern of the places behind the given residues, unless one of the residue's sections stands around it.

    `{"P": ("EGP", "PG")}` cuts behind P, but not where that P ends EGP or begins PG.
    """
    ways = []
    for residue, sections in cutters.items():
        barred = "".join(f"(?!(?<={s[: s.index(residue) + 1]}){s[s.index(residue) + 1 :]})" for s in sections)
        ways.append(f"(?<={residue}){barred}(?=.)")
    return "|".join(ways)


def digest_rows(rows: DataFrame, key: str, sequence: str, missed: int = 2, least: int = 7, most: int = 50, cuts: str = TRYPSIN, bare: bool = False) -> DataFrame:
    """(key, start, end, peptide): the digest as rows, for long sequences. Pieces are cut once and joined to the next ones.

    cuts: a pattern of the places. bare: peptides that begin with the sequence's first M come without it, too.
    """
    cut = rows.where(F.length(sequence) > 0).select(key, F.posexplode(F.split(sequence, cuts)).alias("_i", "_p"))
    by = W.partitionBy(key).orderBy("_i")
    start = F.coalesce(F.sum(F.length("_p")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    # A join with a piece past the end is null.
    joined = [F.concat("_p", *[F.lead("_p", j).over(by) for j in range(1, m + 1)]) for m in range(missed + 1)]
    each = cut.select(key, start.alias("start"), F.array(*joined).alias("_all")).select(key, "start", F.explode("_all").alias("peptide"))
    if bare:
        whole, rest = F.struct("start", "peptide"), F.struct((F.col("start") + 1).alias("start"), F.substr("peptide", F.lit(2)).alias("peptide"))
        first_met = (F.col("start") == 0) & F.startswith("peptide", F.lit("M"))
        each = each.select(key, F.explode(F.when(first_met, F.array(whole, rest)).otherwise(F.array(whole))).alias("_x")).select(key, "_x.start", "_x.peptide")
    return each.where(F.length("peptide").between(least, most)).select(key, "start", (F.col("start") + F.length("peptide")).alias("end"), "peptide")


def digest_peptides(sequence: Column, missed: int = 2, least: int = 7, most: int = 50, cuts: str = TRYPSIN) -> Column:
    """The peptides of `digest_rows`, as an array by start and end: for what is asked of a sequence alone, without an exchange.

    A row's work and memory grow with its own sequence.
    """
    # The pieces are bound once; a join with a piece past the end is null.
    joined = lambda p: F.flatten(F.transform(p, lambda x, i: F.array(*[F.concat(x, *[F.get(p, i + j) for j in range(1, m + 1)]) for m in range(missed + 1)])))
    each = F.get(F.transform(F.array(F.split(sequence, cuts)), joined), F.lit(0))
    return F.filter(each, lambda x: F.length(x).between(least, most))


def digest(sequence: Column, missed: int = 2, least: int = 7, most: int = 50) -> Column:
    """Distinct (start, end, peptide) spans, half-open from 0, of the tryptic digest within the length bounds.

    For sequences of a protein's length; `digest_rows` takes any.
    """
    return F.get(F.transform(F.array(cut_sites(sequence)), lambda sites: _spans(sequence, sites, missed, least, most)), F.lit(0))


def _spans(sequence: Column, sites: Column, missed: int, least: int, most: int) -> Column:
    # The sites are bound once by the caller's lambda: a column used in a lambda is worked out for every element.
    froms = F.when(F.size(sites) > 1, F.sequence(F.lit(1), F.size(sites) - 1)).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(
        F.transform(
            froms,
            lambda i: F.transform(
                F.sequence(i + 1, F.least(i + 1 + missed, F.size(sites))), lambda j: F.struct(F.element_at(sites, i).alias("start"), F.element_at(sites, j).alias("end"))
            ),
        )
    )
    fit = F.filter(spans, lambda s: (s.end - s.start >= least) & (s.end - s.start <= most))
    return F.transform(F.array_distinct(fit), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.substr(sequence, s.start + 1, s.end - s.start).alias("peptide")))


def tiling(sequence: Column, least: int = 7, most: int = 50) -> Column:
    """Fully cut segments over the whole sequence, with whether a search would have tried them."""
    sites = cut_sites(sequence)
    froms = F.when(F.size(sites) > 1, F.sequence(F.lit(1), F.size(sites) - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda i: F.struct(F.element_at(sites, i).alias("start"), F.element_at(sites, i + 1).alias("end"))
    return F.transform(F.transform(froms, cut), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), (s.end - s.start).between(least, most).alias("searchable")))


def coverage_string(sequence: Column, cuts: Column) -> Column:
    """The sequence with a bar at every distinct inner cut (residues before it)."""
    inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > 0) & (c < F.length(sequence)))))
    ends = F.concat(inner, F.array(F.length(sequence)))
    starts = F.concat(F.array(F.lit(0)), inner)
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(sequence, a + 1, b - a)), "|")


def isotope_pattern(atoms: dict[str, int], cutoff: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(mean mass, abundance) by nominal mass; abundances below the cutoff at the end are left off.

    Every element is a polynomial in the nominal mass whose coefficients carry abundance and
    abundance-weighted mass; powers come by squaring, so each nominal mass is summed exactly.
    """
    p, m = np.ones(1), np.zeros(1)
    for element, count in atoms.items():
        base = [round(mass) for mass, _ in ISOTOPES[element]]
        q, w = np.zeros(base[-1] - base[0] + 1), np.zeros(base[-1] - base[0] + 1)
        for (mass, share), b in zip(ISOTOPES[element], base):
            q[b - base[0]], w[b - base[0]] = share, share * mass
        n = int(count)
        while n > 0:
            if n & 1:
                p, m = _cut(np.convolve(p, q), np.convolve(m, q) + np.convolve(p, w), cutoff)
            q, w = _cut(np.convolve(q, q), 2 * np.convolve(q, w), cutoff)
            n >>= 1
    kept = p > cutoff
    return m[kept] / p[kept], p[kept]


def _cut(p: np.ndarray, m: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Without the end that is far below the cutoff."""
    last = np.flatnonzero(p > cutoff * 1e-6)
    n = last[-1] + 1 if last.size else 1
    return p[:n], m[:n]


@F.pandas_udf(PATTERN)
def isotopes(atoms: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Isotope pattern of a composition struct; equal compositions are worked out once a batch."""
    for batch in atoms:
        known, out = {}, []
        for row in batch.itertuples(index=False):
            if any(pd.isna(x) for x in row):
                out.append(None)
                continue
            if row not in known:
                known[row] = [{"mass": float(a), "abundance": float(b)} for a, b in zip(*isotope_pattern(dict(zip(batch.columns, row))))]
            out.append(known[row])
        yield pd.Series(out, dtype=object)


def isotope_bars(pattern: Column, mass: Column, charge: Column, n: int = 8) -> Column:
    """(mz, abundance) of the first n peaks of a pattern, placed from a measured neutral mass."""
    first = F.slice(pattern, 1, n)
    return F.transform(first, lambda x, i: F.struct((mass / charge + PROTON + i * C13_STEP / charge).alias("mz"), x.abundance.alias("abundance")))


#: What an ambiguous residue may stand for.
AMBIGUOUS = {"B": ("D", "N"), "J": ("L", "I"), "Z": ("E", "Q")}


def _letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def resolved(sequence: Column) -> Column:
    """All plain readings of a sequence with ambiguous residues; none where it holds X."""
    options = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = lambda c: F.coalesce(F.try_element_at(options, c), F.array(c))
    grown = F.aggregate(_letters(sequence), F.array(F.lit("")), lambda a, c: F.flatten(F.transform(a, lambda s: F.transform(each(c), lambda o: F.concat(s, o)))))
    return F.when(F.contains(sequence, F.lit("X")), F.array().cast("array<string>")).otherwise(grown)


def modified(sequence: Column, modifiers: dict[str, tuple[str, ...]], most: int) -> Column:
    """Array of (text, n): the sequence with each choice of at most `most` residues modified, n of them; itself among them.

    modifiers: for a residue, what may stand in its place (as `m` or `M[+15.99]`).
    """
    options = F.create_map(*[x for k, v in modifiers.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    row = lambda text, n: F.struct(text.alias("text"), n.alias("n"))

    def grow(a: Column, c: Column) -> Column:
        changed = F.coalesce(F.try_element_at(options, c), F.array().cast("array<string>"))
        each = lambda s: F.concat(F.array(row(F.concat(s.text, c), s.n)), F.when(s.n < most, F.transform(changed, lambda o: row(F.concat(s.text, o), s.n + 1))).otherwise(F.array().cast("array<struct<text:string,n:int>>")))
        return F.flatten(F.transform(a, each))

    return F.aggregate(_letters(sequence), F.array(row(F.lit(""), F.lit(0))), grow)


def formula(atoms: Column) -> Column:
    """Elements with their numbers, those without atoms left out: `C6H12O6`."""
    return F.concat(*[F.when(atoms[e] > 0, F.concat(F.lit(e), atoms[e].cast("string"))).otherwise("") for e in ELEMENTS[:6]])


def by_formula(rows: DataFrame, sequence: str) -> DataFrame:
    """(formula, atoms, n, sequences): distinct sequences of equal composition together; unknown residues are left out."""
    own = rows.select(F.col(sequence).alias("sequence")).distinct().withColumn("atoms", composition(F.col("sequence"))).where("atoms.C IS NOT NULL")
    return own.groupBy(formula(F.col("atoms")).alias("formula")).agg(F.first("atoms").alias("atoms"), F.count("*").alias("n"), F.array_sort(F.collect_list("sequence")).alias("sequences"))


def shuffled(sequence: Column, seed: int = 0) -> Column:
    """The sequence with its inner residues in an order drawn from the seed and the sequence; the ends stay."""
    inner = F.transform(_letters(F.substr(sequence, F.lit(2), F.length(sequence) - 2)), lambda c, i: F.struct(F.xxhash64(F.lit(seed), sequence, i).alias("o"), i.alias("i"), c.alias("c")))
    mixed = F.array_join(F.transform(F.array_sort(inner), lambda s: s.c), "")
    return F.when(F.length(sequence) > 3, F.concat(F.substring(sequence, 1, 1), mixed, F.substr(sequence, F.length(sequence)))).otherwise(sequence)


def isotope_bar_kinds(pattern: Column, charge: Column, n: int = 8) -> Column:
    """Array of (mz, raw, share, relative) of a pattern's first n peaks: as they are, of their sum, of the largest."""
    first = F.slice(pattern, 1, n)
    total, top = F.aggregate(first, F.lit(0.0), lambda a, x: a + x.abundance), F.array_max(F.transform(first, lambda x: x.abundance))
    return F.transform(first, lambda x: F.struct(((x.mass + PROTON * charge) / charge).alias("mz"), x.abundance.alias("raw"), (x.abundance / total).alias("share"), (x.abundance / top).alias("relative")))
