"""Quantity matrices, normalisation and contrasts (long form: feature, file, quantity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.operators.graph import settled
from spectraloom.operators.store import quantile_block


def feature_by_file(rows: DataFrame, feature: str, file: str, quantity: str) -> DataFrame:
    """Sum of non-null quantities per (feature, file)."""
    return rows.where(F.col(quantity).isNotNull()).groupBy(feature, file).agg(F.sum(quantity).alias("quantity"))


def median_center(matrix: DataFrame, file: str) -> DataFrame:
    """log2, subtract the file's median, add the median of the medians, back to linear.

    Quantities that are not positive are left out. Medians come from counted ranks, so that no task holds
    a file's values; they are one row a file, joined to the matrix.
    """
    logged = matrix.where(F.col("quantity") > 0).withColumn("log_q", F.log2("quantity"))
    middle = lambda rows, value, *keys: quantile_block(rows, value, *keys, probabilities={"p50": 0.5})
    medians = settled(middle(logged, "log_q", file).select(file, F.col("value").alias("file_median")), "medians")
    grand = middle(medians, "file_median").select(F.col("value").alias("grand_median"))
    return (
        logged.join(medians.crossJoin(grand), file)
        .withColumn("quantity", F.pow(F.lit(2.0), F.col("log_q") - F.col("file_median") + F.col("grand_median")))
        .drop("log_q", "file_median", "grand_median")
    )


def fold_change(matrix: DataFrame, feature: str, condition: Column, a: str, b: str) -> DataFrame:
    """log2(A) - log2(B) of mean log2 quantities; features need both sides."""
    side = lambda v: F.avg(F.when(condition == v, F.log2("quantity")))
    both = matrix.groupBy(feature).agg(side(a).alias("mean_a"), side(b).alias("mean_b"))
    return both.where("mean_a IS NOT NULL AND mean_b IS NOT NULL").select(
        feature,
        (F.col("mean_a") - F.col("mean_b")).alias("log2_fc"),
        ((F.col("mean_a") + F.col("mean_b")) / 2).alias("mean_abundance"),
    )


def tagged_union(parts: dict[str, DataFrame], name: str = "filename") -> DataFrame:
    """All files' rows in one table, each with its file's name; columns that a file lacks are null."""
    out = None
    for file, rows in parts.items():
        one = rows.withColumn(name, F.lit(file))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def unique_features(rows: DataFrame, feature: str, proteins: str, order: Column) -> DataFrame:
    """(feature, protein) of features whose first row, by order, names one protein alone."""
    first = rows.groupBy(feature).agg(F.min_by(S.items(F.col(proteins), r"[;,\s]+"), order).alias("_p"))
    return first.where(F.size("_p") == 1).select(feature, F.get("_p", F.lit(0)).alias("protein"))


def protein_by_file(matrix: DataFrame, unique: DataFrame, feature: str, file: str) -> DataFrame:
    """(protein, file, quantity): sums over the features of one protein; shared ones count nowhere."""
    return matrix.join(unique, feature).groupBy("protein", file).agg(F.sum("quantity").alias("quantity"))


def quantities_of(rows: DataFrame, feature: str, file: str, quantity: str, *wanted: str) -> DataFrame:
    """(feature, file, quantity) of some features: sums, missing quantities as 0."""
    return rows.where(F.col(feature).isin(*wanted)).groupBy(feature, file).agg(F.sum(F.coalesce(F.col(quantity), F.lit(0.0))).alias("quantity"))


def visible(matrix: DataFrame, unique: DataFrame | None, feature: str) -> DataFrame:
    """The features of a matrix in order, or the unique ones alone."""
    found = matrix.select(feature).distinct()
    return (found if unique is None else found.join(unique.select(feature), feature, "left_semi")).orderBy(feature)


def group_means(matrix: DataFrame, feature: str, group: list[Column], replicate: list[Column] | None = None) -> DataFrame:
    """(feature, groups, mean_log): mean log2 quantity of a group; with replicate columns, their linear means first.

    Quantities that are not positive are left out. Groups keep the names that their columns carry.
    """
    rows = matrix.where(F.col("quantity") > 0)
    if replicate is not None:
        rows = rows.groupBy(feature, *group, *replicate).agg(F.avg("quantity").alias("quantity"))
        group = [F.col(rows.columns[1 + i]) for i in range(len(group))]
    return rows.groupBy(feature, *group).agg(F.avg(F.log2("quantity")).alias("mean_log"))


def cross_tab(matrix: DataFrame, feature: str, path: list[Column], paths: list[str]) -> DataFrame:
    """A row a feature, a column for each named path of nested categories (`a/b`): the mean of positive quantities there."""
    named = matrix.select(feature, "quantity", F.concat_ws("/", *path).alias("_path"))
    return named.groupBy(feature).pivot("_path", paths).agg(F.avg(F.when(F.col("quantity") > 0, F.col("quantity"))))


def facets(rows: DataFrame, splits: list[Column], x: Column, value: Column) -> DataFrame:
    """(level, path, x, n, total): a tree split by one column after the other; level 0 is the whole, the last the leaves.

    Each level's node has, for every x, how many values it holds and their sum. One pass: a row is counted at every level.
    """
    parts = F.array(*[s.cast("string") for s in splits])
    at = rows.select(parts.alias("_s"), x.alias("x"), value.alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(len(splits)))).alias("level"))
    at = at.withColumn("path", F.array_join(F.slice("_s", F.lit(1), F.col("level")), "/"))
    return at.where(F.col("_v").isNotNull()).groupBy("level", "path", "x").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def design_groups(design: DataFrame, *columns: str) -> DataFrame:
    """(columns, filenames): the files of each combination of categories."""
    return design.groupBy(*columns).agg(F.array_sort(F.collect_list("filename")).alias("filenames"))


def design_values(design: DataFrame, column: str, order: Column) -> DataFrame:
    """(value, place): a category's values in the order in which they first come, blank ones left out."""
    return design.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.min(order).alias("place")).orderBy("place")


def design_files(design: DataFrame, **wanted: str) -> DataFrame:
    """Files whose categories have all the values asked for."""
    out = design
    for column, value in wanted.items():
        out = out.where(F.coalesce(F.col(column), F.lit("")) == value)
    return out.select("filename")


def summed_trace_area(points: DataFrame, key: list[str], time: str = "rt") -> DataFrame:
    """(key, auc): intensities summed at each time, then the trapezoid area over the times in order."""
    summed = points.groupBy(*key, time).agg(F.sum("intensity").alias("_y"))
    by = W.partitionBy(*key).orderBy(time)
    slab = (F.col(time) - F.lag(time).over(by)) * (F.col("_y") + F.lag("_y").over(by)) / 2
    return summed.withColumn("_s", slab).groupBy(*key).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("auc"))


def region_stats(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_points, mz_mean, mz_low, mz_high, intensity): a region's points, m/z weighted by intensity."""
    total = F.sum("intensity")
    mean = F.when(total > 0, F.sum(F.col("mz") * F.col("intensity")) / total).otherwise(F.avg("mz"))
    return points.groupBy(*key).agg(F.count("*").alias("n_points"), mean.alias("mz_mean"), F.min("mz").alias("mz_low"), F.max("mz").alias("mz_high"), total.alias("intensity"))
