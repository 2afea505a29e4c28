"""Look-ups, roll-ups, checks and reports over the detection's tables.

Tables have a `file_id`; ids count within a file. `distributions` has distribution_id, charge,
mono_mz, neutral_mass, rt_start, rt_apex, rt_end, n_members, score, quality, status; `members`
(distribution_id, feature_id, isotope_index); `analyte_members` (analyte_id, distribution_id, charge).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.operators.graph import settled

FILE = "file_id"


def by_id(rows: DataFrame, name: str, *ids: int) -> DataFrame:
    """The rows of some ids: a filter that reaches the scan."""
    return rows.where(F.col(name).isin(*ids))


def in_window(
    dists: DataFrame, mz: tuple[float | None, float | None] = (None, None), rt: tuple[float | None, float | None] = (None, None), charge: int | None = None, status: str | None = None, limit: int | None = 2000
) -> DataFrame:
    """Distributions whose monoisotopic m/z lies in a range and whose time meets one, the best quality first.

    status: `recovered` for that tier alone, `primary` for all others, null for every one. Ties go by id.
    """
    tests = [
        (mz[0], lambda v: F.col("mono_mz") >= v),
        (mz[1], lambda v: F.col("mono_mz") <= v),
        (rt[0], lambda v: F.col("rt_end") >= v),
        (rt[1], lambda v: F.col("rt_start") <= v),
        (charge, lambda v: F.col("charge") == v),
        (status, lambda v: (F.col("status") == "recovered") if v == "recovered" else (F.col("status") != "recovered")),
    ]
    out = dists
    for value, test in tests:
        if value is not None:
            out = out.where(test(value))
    return top(out, [F.desc("quality"), F.asc("distribution_id")], limit)


def top(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def members_of(members: DataFrame, features: DataFrame, *ids: int) -> DataFrame:
    """Member features of some distributions, or of all; `isotope_index` orders them."""
    chosen = by_id(members, "distribution_id", *ids) if ids else members
    return chosen.join(features, [FILE, "feature_id"])


def noise_features(features: DataFrame, members: DataFrame, mz: tuple[float, float] | None = None, rt: tuple[float, float] | None = None, limit: int | None = None) -> DataFrame:
    """Features that overlap the window and belong to no distribution, by id."""
    out = features
    if mz:
        out = out.where((F.col("mz_min") <= mz[1]) & (F.col("mz_max") >= mz[0]))
    if rt:
        out = out.where((F.col("rt_start") <= rt[1]) & (F.col("rt_end") >= rt[0]))
    out = out.join(members.select(FILE, "feature_id"), [FILE, "feature_id"], "left_anti")
    return out if limit is None else top(out, [F.asc(FILE), F.asc("feature_id")], limit)


def all_lines(features: DataFrame, members: DataFrame, dists: DataFrame) -> DataFrame:
    """Every feature with the charge of each distribution that has it, 0 if none."""
    charged = members.select(FILE, "feature_id", "distribution_id").join(dists.select(FILE, "distribution_id", "charge"), [FILE, "distribution_id"], "left")
    out = features.join(charged.drop("distribution_id"), [FILE, "feature_id"], "left")
    return out.withColumn("charge", F.coalesce("charge", F.lit(0)))


def areas(members: DataFrame, features: DataFrame) -> DataFrame:
    """(file_id, distribution_id, auc): the summed areas of a distribution's members."""
    return members.join(features.select(FILE, "feature_id", "area"), [FILE, "feature_id"]).groupBy(FILE, "distribution_id").agg(F.sum("area").alias("auc"))


def with_area(dists: DataFrame, members: DataFrame, features: DataFrame) -> DataFrame:
    """Distributions with `auc`, 0 where no member is known."""
    return dists.join(areas(members, features), [FILE, "distribution_id"], "left").withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def multicharge(analytes: DataFrame, analyte_members: DataFrame, members: DataFrame, features: DataFrame) -> DataFrame:
    """Analytes of several charges, with their smallest distribution as a representative and the area of all members."""
    auc = analyte_members.select(FILE, "analyte_id", "distribution_id").join(areas(members, features), [FILE, "distribution_id"], "left")
    rolled = auc.groupBy(FILE, "analyte_id").agg(F.min("distribution_id").alias("rep_distribution_id"), F.coalesce(F.sum("auc"), F.lit(0.0)).alias("auc"))
    out = analytes.where("charge_max > charge_min").join(rolled, [FILE, "analyte_id"], "left")
    return out.withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def analyte_distributions(analyte_members: DataFrame, dists: DataFrame, members: DataFrame, features: DataFrame, *ids: int) -> DataFrame:
    """The distributions of some analytes, or of all, with their areas; `charge` orders them."""
    chosen = by_id(analyte_members, "analyte_id", *ids) if ids else analyte_members
    return with_area(chosen.select(FILE, "analyte_id", "distribution_id").join(dists, [FILE, "distribution_id"]), members, features)


def charge_groups(analyte_members: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (file_id, distribution_id), one distribution a charge of its analyte: itself in its own slot, else the smallest id.

    One that is in no analyte stands alone, with a null analyte and charge.
    """
    own = asked.select(FILE, F.col("distribution_id").alias("asked"))
    home = analyte_members.select(FILE, "analyte_id", F.col("distribution_id").alias("asked"))
    found = own.join(home, [FILE, "asked"], "left").join(analyte_members.select(FILE, "analyte_id", "distribution_id", "charge"), [FILE, "analyte_id"], "left")
    slot = W.partitionBy(FILE, "asked", "charge").orderBy(F.desc(F.col("distribution_id") == F.col("asked")), "distribution_id")
    out = found.withColumn("_n", F.row_number().over(slot)).where("_n = 1").drop("_n")
    return out.withColumn("distribution_id", F.coalesce("distribution_id", "asked"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not there."""
    return children.join(parents.select(FILE, key), [FILE, key], "left_anti")


def miscounted(parents: DataFrame, children: DataFrame, key: str, expected: str) -> DataFrame:
    """(file_id, key, expected, observed) of parents that have another number of children than they say."""
    seen = children.groupBy(FILE, key).agg(F.count("*").alias("observed"))
    out = parents.select(FILE, key, F.col(expected).cast("long").alias("expected")).join(seen, [FILE, key], "left")
    return out.withColumn("observed", F.coalesce("observed", F.lit(0))).where("observed <> expected")


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, fraction): group sizes and their share of all rows."""
    # The total runs over one row a group.
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def charge_span(analytes: DataFrame) -> DataFrame:
    """(span, n, fraction): how many charges analytes reach over."""
    return counts_by(analytes.select((F.col("charge_max") - F.col("charge_min") + 1).alias("span")), "span")


#: What a quantile block reports.
PROBABILITIES = {"min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}


def quantile_block(rows: DataFrame, value: str, *keys: str, probabilities: dict[str, float] = PROBABILITIES) -> DataFrame:
    """(keys, quantile, value): linear interpolation between ranks; null, infinite and not-a-number values are left out.

    Ranks are counted, not gathered: values are range-partitioned and written, each partition knows how many of each
    group stand before it, and only the two values at each quantile's place are kept. No task holds a group.
    """
    x = F.col(value).cast("double")
    finite = rows.select(*keys, x.alias("_x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal values count once, so that a very common one does not fill a partition.
    sized = finite.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    # Written, so that every reader sees the same bounds.
    dealt = settled(sized.repartitionByRange(n_parts, *keys, "_x").withColumn("_p", F.spark_partition_id()), "dealt")
    by = list(keys) or [F.lit(1)]
    within = F.sum("_c").over(W.partitionBy(*by, "_p").orderBy("_x"))
    ranked = dealt.withColumn("_upto", within)
    starts = dealt.groupBy(*keys, "_p").agg(F.sum("_c").alias("_in"), F.min("_x").alias("_low"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy(*by).orderBy("_low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumns({"_before": before, "_all": F.sum("_in").over(W.partitionBy(*by))}).select(*keys, "_p", "_before", "_all")
    ranked = ranked.join(starts, [*keys, "_p"])
    last = F.col("_before") + F.col("_upto") - 1  # places from 0
    first = last - F.col("_c") + 1
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("quantile"), F.lit(p).alias("p")) for k, p in probabilities.items()])).alias("q")
    held = ranked.select(*keys, "_x", "_all", first.alias("_first"), last.alias("_last"), names).select(*keys, "_x", "_first", "_last", "q.quantile", (F.col("q.p") * (F.col("_all") - 1)).alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    is_low, is_high = low.between(F.col("_first"), F.col("_last")), high.between(F.col("_first"), F.col("_last"))
    at = held.where(is_low | is_high).groupBy(*keys, "quantile").agg(F.max(F.when(is_low, F.col("_x"))).alias("_l"), F.max(F.when(is_high, F.col("_x"))).alias("_h"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return at.select(*keys, "quantile", F.when(part == 0, F.col("_l")).otherwise(F.col("_l") * (1 - part) + F.col("_h") * part).alias("value"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def reports(dists: DataFrame, analytes: DataFrame, limit: int = 50, tiny: float = 0.02, huge: float = 5.0, low_score: float = 0.5, most_mass: float = 1500.0, least_charge: int = 6, least_members: int = 10) -> dict[str, DataFrame]:
    """The inspection's lists: each a filter, an order (ids last) and the first rows. rt_width is rt_end - rt_start."""
    d = dists.withColumn("rt_width", F.col("rt_end") - F.col("rt_start"))
    i, j = F.asc("distribution_id"), F.asc("analyte_id")
    return {
        "tiny_rt": top(d.where(F.col("rt_width") <= tiny), [F.asc("quality"), F.asc("score"), i], limit),
        "huge_rt": top(d.where(F.col("rt_width") >= huge), [F.desc("rt_width"), F.asc("quality"), i], limit),
        "low_score": top(d.where(F.col("score") <= low_score), [F.asc("score"), F.asc("quality"), i], limit),
        "high_charge_low_mass": top(d.where((F.col("charge") >= least_charge) & (F.col("neutral_mass") <= most_mass)), [F.desc("charge"), F.asc("neutral_mass"), i], limit),
        "large_analytes": top(analytes.where(F.col("n_distributions") >= least_members), [F.desc("n_distributions"), F.desc("score"), j], limit),
        "most_complex": top(d, [F.desc("n_members"), F.desc("quality"), i], limit),
        "highest_quality": top(d, [F.desc("quality"), F.desc("score"), i], limit),
    }


def inspection(tables: dict[str, DataFrame], dists: DataFrame, found: dict[str, DataFrame]) -> str:
    """JSON of the tables' counts, quantiles of score, quality and mass, and the (short) reports."""
    out = {"counts": {r["name"]: r.n for r in table_counts(tables).collect()}, "quantiles": {}, "reports": {}}
    for value in ("score", "quality", "neutral_mass"):
        out["quantiles"][value] = {r.quantile: r.value for r in quantile_block(dists, value).collect()}
    for name, rows in found.items():
        out["reports"][name] = [r.asDict() for r in rows.collect()]  # lists of a limit
    return json.dumps(out, sort_keys=True, default=str)
