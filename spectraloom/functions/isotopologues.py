"""Single isotopologues: which there are above a threshold, the likeliest of a nominal mass, and what fragments keep of it.

A composition's isotopologue is a choice of isotopes for each element's atoms; elements are independent,
so ratios to the likeliest one multiply, and an enumeration can stop at the threshold in each element.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.chemistry import C_IONS, ELEMENTS, ISOTOPES, N_IONS, RESIDUES, isotope_pattern
from spectraloom.functions.scalars import PROTON

Counts = tuple[int, ...]


def _shifts(element: str) -> list[int]:
    masses = [round(m) for m, _ in ISOTOPES[element]]
    return [m - masses[0] for m in masses]


def _log(counts: Counts, shares: list[float]) -> float:
    return lgamma(sum(counts) + 1) + sum(n * log(p) - lgamma(n + 1) for n, p in zip(counts, shares) if n)


def element_choices(element: str, n: int, threshold: float) -> list[tuple[float, Counts]]:
    """(ratio to the likeliest, atoms of each isotope) of an element's n atoms, down to the threshold, the likeliest first.

    The probability has one peak, so all choices above a threshold hang together: they are reached from the
    likeliest by moving one atom at a time.
    """
    shares = [p for _, p in ISOTOPES[element]]
    top = max(range(len(shares)), key=lambda i: shares[i])
    start = [int(n * p) for p in shares]
    start[top] += n - sum(start)

    def neighbours(c: Counts) -> Iterator[Counts]:
        for i, j in product(range(len(c)), repeat=2):
            if i != j and c[i]:
                yield tuple(v - (k == i) + (k == j) for k, v in enumerate(c))

    best = tuple(start)
    while (other := max(neighbours(best), key=lambda c: _log(c, shares), default=best)) and _log(other, shares) > _log(best, shares):
        best = other
    peak, seen, todo = _log(best, shares), {best}, [best]
    while todo:
        for c in neighbours(todo.pop()):
            if c not in seen and _log(c, shares) - peak >= log(threshold):
                seen.add(c)
                todo.append(c)
    return sorted(((float(np.exp(_log(c, shares) - peak)), c) for c in seen), key=lambda x: (-x[0], x[1]))


def isotopologues(atoms: dict[str, int], threshold: float = 0.01) -> list[tuple[float, float, str]]:
    """(ratio to the likeliest, mass, formula) of all isotopologues down to the threshold, the likeliest first."""
    found: list[tuple[float, float, str]] = [(1.0, 0.0, "")]
    for element in [e for e in ELEMENTS if atoms.get(e, 0) > 0]:
        choices = element_choices(element, atoms[element], threshold)
        grown = []
        for ratio, mass, text in found:
            for r, counts in choices:
                if ratio * r < threshold:
                    break
                parts = [(m, n) for (m, _), n in zip(ISOTOPES[element], counts) if n]
                grown.append((ratio * r, mass + sum(m * n for m, n in parts), text + "".join(f"{element}{round(m)}({n})" for m, n in parts)))
        found = grown
    return sorted(found, key=lambda x: (-x[0], x[2]))


def likeliest(atoms: dict[str, int], shift: int) -> dict[str, Counts] | None:
    """The likeliest isotopologue that is `shift` nominal masses above the lightest: for each element, atoms of each isotope."""
    best: dict[int, tuple[float, dict[str, Counts]]] = {0: (0.0, {})}
    for element, n in atoms.items():
        if n <= 0:
            continue
        steps, shares = _shifts(element), [p for _, p in ISOTOPES[element]]
        own: dict[int, tuple[float, Counts]] = {}
        heavy = [range(min(n, shift // s) + 1) for s in steps[1:]]
        for counts in product(*heavy):
            up = sum(c * s for c, s in zip(counts, steps[1:]))
            if up <= shift and sum(counts) <= n:
                whole = (n - sum(counts), *counts)
                value = _log(whole, shares)
                if up not in own or value > own[up][0]:
                    own[up] = (value, whole)
        grown: dict[int, tuple[float, dict[str, Counts]]] = {}
        for a, (x, held) in best.items():
            for b, (y, counts) in own.items():
                if a + b <= shift and (a + b not in grown or x + y > grown[a + b][0]):
                    grown[a + b] = (x + y, {**held, element: counts})
        best = grown
    return best[shift][1] if shift in best else None


def fragment_mass(atoms: dict[str, int], parent: dict[str, Counts]) -> float:
    """Mean mass of a fragment's likeliest nominal mass, its atoms drawn by the parent's isotope shares."""
    p, m = np.ones(1), np.zeros(1)
    for element, n in atoms.items():
        if n <= 0:
            continue
        counts = parent.get(element) or (1, *[0] * (len(ISOTOPES[element]) - 1))
        steps = _shifts(element)
        q, w = np.zeros(steps[-1] + 1), np.zeros(steps[-1] + 1)
        for (mass, _), step, c in zip(ISOTOPES[element], steps, counts):
            q[step], w[step] = c / sum(counts), mass * c / sum(counts)
        last = np.flatnonzero(q)[-1] + 1
        q, w = q[:last], w[:last]
        while n:
            if n & 1:
                p, m = np.convolve(p, q), np.convolve(m, q) + np.convolve(p, w)
            q, w = np.convolve(q, q), 2 * np.convolve(q, w)
            n >>= 1
    top = int(np.argmax(p))
    return float(m[top] / p[top])


def _sum(*parts: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for part in parts:
        for e, n in part.items():
            out[e] = out.get(e, 0) + n
    return out


def atoms_of(sequence: str, extra: tuple[int, ...] = ()) -> dict[str, int]:
    return _sum(*[dict(zip(ELEMENTS, RESIDUES[r])) for r in sequence], dict(zip(ELEMENTS, extra)))


def fragment_ions(sequence: str, charge: int, low: float, high: float, ions: str = "by", charges: tuple[int, ...] = (1, 2), threshold: float = 0.01) -> list[tuple[str, int, int, int, float, float]]:
    """(ion, place, isotope, charge, neutral mass, m/z) of the fragments of each precursor isotope in the isolation window.

    Isotopes are the precursor's nominal masses down to the threshold of the largest, numbered by mass; the first counts
    wherever the window lies. A fragment's mass is that of its likeliest isotopes, its parent being the likeliest of its nominal mass.
    """
    if len(sequence) < 2 or any(r not in RESIDUES for r in sequence):
        return []
    whole = atoms_of(sequence, (0, 2, 0, 1))
    masses, shares = isotope_pattern(whole)
    out = []
    for isotope, (mass, share) in enumerate(zip(masses, shares)):
        at = mass / charge + PROTON
        if isotope and not (low <= at <= high and share >= threshold * shares.max()):
            continue
        if (parent := likeliest(whole, isotope)) is None:
            continue
        for place in range(1, len(sequence)):
            for ion in ions:
                part = sequence[:place] if ion in N_IONS else sequence[len(sequence) - place :]
                neutral = fragment_mass(atoms_of(part, N_IONS.get(ion) or C_IONS[ion]), parent)
                out += [(ion, place, isotope, z, neutral, neutral / z + PROTON) for z in charges]
    return out


def fragment_isotopes(precursors: DataFrame, ions: str = "by", charges: tuple[int, ...] = (1, 2), threshold: float = 0.01) -> DataFrame:
    """(precursor_id, ion, place, isotope, charge, neutral_mass, mz) of (precursor_id, sequence, charge, low, high) rows.

    Rows with nulls in what is needed, and sequences with other letters than residues, have none.
    """
    asked_for = ["sequence", "charge", "low", "high"]
    names = [*asked_for, "ion", "place", "isotope", "fragment_charge", "neutral_mass", "mz"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sequence, charge, low, high in batch.itertuples(index=False):
                rows += [(sequence, charge, low, high, *f) for f in fragment_ions(sequence, int(charge), low, high, ions, charges, threshold)]
            yield pd.DataFrame(rows, columns=names)

    asked = precursors.select("precursor_id", *asked_for).dropna().where("charge > 0")
    each = asked.select(*asked_for).distinct()
    kinds = ", ".join(f"{c} {each.schema[c].dataType.simpleString()}" for c in asked_for)
    found = each.mapInPandas(run, f"{kinds}, ion string, place int, isotope int, fragment_charge int, neutral_mass double, mz double")
    # Precursors of one sequence, charge and window have the same fragments; these are worked out once.
    out = asked.join(found, asked_for)
    return out.select("precursor_id", "ion", "place", "isotope", F.col("fragment_charge").alias("charge"), "neutral_mass", "mz")


def enumerated(compositions: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(formula, ratio, mass, isotopologue) of (formula, atoms struct) rows: every isotopologue down to the threshold."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *x) for f, atoms in zip(batch["formula"], batch["atoms"]) for x in isotopologues({e: int(n) for e, n in dict(atoms).items()}, threshold)]
            yield pd.DataFrame(rows, columns=["formula", "ratio", "mass", "isotopologue"])

    return compositions.select("formula", "atoms").dropna().mapInPandas(run, "formula string, ratio double, mass double, isotopologue string")


def extend_library(peptides: DataFrame, library: DataFrame | None, most_mass: float = 8000.0, threshold: float = 0.01) -> DataFrame:
    """(formula, ratio, mass, isotopologue) for every formula of the peptides: rows of the library where it has them, new ones else.

    peptides: (sequence). Formulas above the mass limit are left out. Formulas are few beside sequences, and each is worked out once.
    """
    from spectraloom.functions import chemistry as C

    asked = C.by_formula(peptides, "sequence").where(C.peptide_mass(F.get("sequences", F.lit(0))) <= most_mass).select("formula", "atoms")
    if library is None:
        return enumerated(asked, threshold)
    known = library.join(asked.select("formula"), "formula", "left_semi")
    return known.unionByName(enumerated(asked.join(library.select("formula").distinct(), "formula", "left_anti"), threshold))
