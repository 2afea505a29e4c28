"""Peaks of arrays: apexes, bounds, centroids, and the cutting of long traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _turns(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of strict local maxima and minima; an end counts by its one neighbour, a plateau never."""
    if v.size < 2:
        return np.zeros(v.size, bool), np.zeros(v.size, bool)
    rise, fall = v[1:] > v[:-1], v[1:] < v[:-1]
    high = np.r_[fall[0], rise[:-1] & fall[1:], rise[-1]]
    low = np.r_[rise[0], fall[:-1] & rise[1:], fall[-1]]
    return high, low


def apexes(values: np.ndarray, spacing: int = 0) -> np.ndarray:
    """Places of the maxima, after minima closer than `spacing` to another turn are taken out, again and again.

    A maximum that once stood free stays. An array without a strict maximum has its largest value as one.
    """
    left, free = np.arange(values.size), []
    while True:
        high, low = _turns(values[left])
        turns = np.flatnonzero(high | low)
        gap = np.diff(turns)
        alone = (np.r_[spacing, gap] >= spacing) & (np.r_[gap, spacing] >= spacing) if turns.size else np.zeros(0, bool)
        free.append(left[turns[alone & high[turns]]])
        crowded = turns[~alone & low[turns]]
        if crowded.size == 0:
            break
        left = np.delete(left, crowded)
    last = left[high] if high.any() else left[[np.argmax(values[left])]]
    return np.unique(np.concatenate([last, *free]))


def find_peaks(values: np.ndarray, spacing: int = 0) -> np.ndarray:
    """Rows (left, apex, right), right exclusive: bounds are the lowest points nearest the apex, up to the next apexes."""
    values = np.asarray(values, float)
    if values.size == 0:
        return np.empty((0, 3), int)
    tops = apexes(values, spacing)
    before, after = np.r_[0, tops[:-1]], np.r_[tops[1:], values.size - 1]
    rows = []
    for b, t, a in zip(before, tops, after):
        climb, drop = values[b : t + 1], values[t : a + 1]
        rows.append((t - int(np.argmin(climb[::-1])), t, t + int(np.argmin(drop)) + 1))
    return np.unique(np.array(rows, int), axis=0)


def centroids(mz: np.ndarray, intensity: np.ndarray, height: str = "area", place: str = "average") -> tuple[np.ndarray, np.ndarray]:
    """One (m/z, intensity) a peak: weighted mean or the top's m/z; area, maximum or sum. Peaks without intensity go under `average`."""
    if mz.size != intensity.size:
        raise ValueError(f"{mz.size} m/z values but {intensity.size} intensities")
    out = []
    for a, _, b in find_peaks(intensity):
        x, y = mz[a:b], intensity[a:b]
        if x.size == 0 or (place == "average" and y.sum() <= 0):
            continue
        at = (x * y).sum() / y.sum() if place == "average" else x[y.argmax()]
        size = {"area": lambda x=x, y=y: np.trapezoid(y, x) if x.size > 1 else y[0], "max": y.max, "sum": y.sum}[height]()
        out.append((at, size))
    both = np.array(out, float).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def smooth(values: np.ndarray, width: int) -> np.ndarray:
    """Moving sum over `width` divided by it; nothing beyond the ends, short arrays as they are."""
    values = np.asarray(values, float)
    return values if width <= 1 or values.size < width else np.convolve(values, np.full(width, 1 / width), "same")


PEAKS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("left", "apex", "right")]))
POINTS = T.StructType([T.StructField("mz", T.ArrayType(T.DoubleType())), T.StructField("intensity", T.ArrayType(T.DoubleType()))])


def peaks_udf(spacing: int = 0):
    """Column function: array<double> to its peaks."""

    @F.pandas_udf(PEAKS)
    def peaks(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda v: None if v is None else [dict(zip(("left", "apex", "right"), map(int, r))) for r in find_peaks(v, spacing)])

    return peaks


def centroid_udf(height: str = "area", place: str = "average"):
    """Column function: (m/z array, intensity array) to a struct of centroided arrays; null in, null out."""

    @F.pandas_udf(POINTS)
    def centroid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for mz, intensity in batches:
            pairs = [(None, None) if m is None or i is None else centroids(np.asarray(m, float), np.asarray(i, float), height, place) for m, i in zip(mz, intensity)]
            yield pd.DataFrame({"mz": [p[0] for p in pairs], "intensity": [p[1] for p in pairs]})

    return centroid
