"""Joins that equality alone does not express: bands, nearest values, as-of, keep-last, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    last = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, keys: list[str] = (), strict: bool = False) -> DataFrame:
    """Pairs whose values differ by at most (or, if strict, less than) the tolerance.

    Values fall into bins as wide as the tolerance. A left row probes its bin and both
    neighbours, a right row lies in one, so pairs meet once and the join is on equality.
    """
    probe = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(a) / tolerance) + d for d in (-1, 0, 1)])))
    filed = right.withColumn("_bin", F.floor(F.col(b) / tolerance)).withColumnsRenamed({k: f"_{k}" for k in keys})
    gap = F.abs(F.col(a) - F.col(b))
    on = (probe["_bin"] == filed["_bin"]) & ((gap < tolerance) if strict else (gap <= tolerance))
    for k in keys:
        on = on & (probe[k] == filed[f"_{k}"])
    return probe.join(filed, on).drop("_bin", *[f"_{k}" for k in keys])


def value_pairs(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, strict: bool = False) -> DataFrame:
    """(a, b): the pairs of different values within the tolerance, each once, however many rows hold them."""
    return band_join(left.select(a).distinct(), right.select(b).distinct(), a, b, tolerance, strict=strict)


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, a: str, b: str, tolerance: float) -> DataFrame:
    """Each left row with its nearest right rows strictly within the tolerance; ties all stay.

    Values are compared, not rows: a value of many rows meets each value of the other side once, and only what is nearest becomes rows.
    """
    gap = F.abs(F.col(a) - F.col(b))
    near = value_pairs(left, right, a, b, tolerance, strict=True).withColumn("_d", gap).withColumn("_r", F.rank().over(W.partitionBy(a).orderBy("_d")))
    near = near.where("_r = 1").select(a, "_d", F.col(b).alias("_v"))
    closest = left.join(near, a).withColumn("_least", F.min("_d").over(W.partitionBy(left_id))).where("_d = _least").drop("_d", "_least")
    return closest.join(right, F.col("_v") == F.col(b)).drop("_v")


def preceding(rows: DataFrame, key: str, order: list[str], is_source: Column, value: Column, name: str) -> DataFrame:
    """The value of the last source row up to and with each row, by key: an as-of join as a window."""
    seen = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(seen))


def islands(rows: DataFrame, key: str, order: list[str], gap: Column, most: float) -> DataFrame:
    """`island` numbers rows of a key anew wherever the gap to the row before exceeds the bound."""
    by = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(gap - F.lag(gap).over(by), F.lit(0)) > most, 1).otherwise(0)).withColumn("island", F.sum("_new").over(by)).drop("_new")


def overlap_join(left: DataFrame, right: DataFrame, key: str, l0: str, l1: str, r0: str, r1: str, width: float) -> DataFrame:
    """Pairs of one key whose intervals overlap (strictly); intervals are filed under each bin that they touch.

    A pair is taken in the bin in which the later of the two begins, so it comes once.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a, b = left.withColumn("_bin", bins(l0, l1)), right.withColumn("_bin", bins(r0, r1)).withColumnRenamed(key, "_key")
    on = (a["_bin"] == b["_bin"]) & (a[key] == F.col("_key")) & (F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1)) & (a["_bin"] == F.floor(F.greatest(F.col(l0), F.col(r0)) / width))
    return a.join(b, on).drop("_bin", "_key")


def ppm_join(left: DataFrame, right: DataFrame, a: str, b: str, ppm: float, keys: list[str] = (), strict: bool = False) -> DataFrame:
    """Pairs (of equal keys) whose values differ by at most, or less than, ppm of the left (positive) one.

    Bins are even in the logarithm and wider than the tolerance at any value. The join is by exchange: the planner
    takes rows that were exploded for as few as before, and would broadcast them.
    """
    width = float(2 * ppm / 1e6)
    at = lambda c: F.floor(F.log(F.col(c)) / width)
    probe = left.where(F.col(a) > 0).withColumn("_bin", F.explode(F.array(*[at(a) + d for d in (-1, 0, 1)])))
    filed = right.where(F.col(b) > 0).withColumn("_bin", at(b))
    gap, most = F.abs(F.col(a) - F.col(b)), F.col(a) / 1e6 * ppm
    return probe.join(filed.hint("merge"), ["_bin", *keys]).where((gap < most) if strict else (gap <= most)).drop("_bin")


def nearest_ppm(left: DataFrame, right: DataFrame, left_id: list[str], a: str, b: str, ppm: float, keys: list[str] = ()) -> DataFrame:
    """Each left row with its nearest right rows (of equal keys) strictly within the tolerance; ties all stay."""
    closest = W.partitionBy(*left_id).orderBy(F.abs(F.col(a) - F.col(b)))
    return ppm_join(left, right, a, b, ppm, keys, strict=True).withColumn("_r", F.rank().over(closest)).where("_r = 1").drop("_r")


def nearest_in_time(rows: DataFrame, sources: DataFrame, key: str, time: str, name: str, value: str) -> DataFrame:
    """Each row with the value of the source nearest in time (the earlier of two as near), by key: one ordered pass over both."""
    own = rows.select("*", F.col(time).alias("_t"), F.lit(None).cast(sources.schema[value].dataType).alias("_v"), F.lit(1).alias("_is_row"))
    other = sources.select(key, F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_is_row"))
    both = own.unionByName(other, allowMissingColumns=True)
    seen = F.when(F.col("_is_row") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    # Sources come before rows of the same time; of several of one time the smallest value counts.
    ahead = W.partitionBy(key).orderBy("_t", "_is_row", F.desc("_v")).rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy(key).orderBy(F.desc("_t"), "_is_row", F.desc("_v")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last(seen, ignorenulls=True).over(ahead), "_b": F.last(seen, ignorenulls=True).over(behind)}).where("_is_row = 1")
    later = F.col("_a").isNull() | ((F.col("_b.t") - F.col("_t")) < (F.col("_t") - F.col("_a.t")))
    return both.withColumn(name, F.when(later, F.col("_b.v")).otherwise(F.col("_a.v"))).drop("_t", "_v", "_is_row", "_a", "_b")


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, key: str, box_key: str, along: tuple[str, str, str], across: tuple[str, str, str], width: float, point_id: list[str], order: list[Column]
) -> DataFrame:
    """Each point in the first (by order) of the boxes of its key that hold it, bounds included; points in none are left out.

    Boxes are filed under every bin of the first axis that they touch, points under their one.
    """
    p, lo, hi = along
    q, low, high = across
    filed = boxes.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    put = points.withColumn("_bin", F.floor(F.col(p) / width))
    on = (put["_bin"] == filed["_bin"]) & (put[key] == filed[box_key]) & F.col(p).between(F.col(lo), F.col(hi)) & F.col(q).between(F.col(low), F.col(high))
    return keep_last(put.join(filed, on).drop("_bin"), point_id, order)
