"""Fragment scoring: the best choice of one peak for each isotope rank of an ion, and its roll-up to scans, distributions and peptides.

A choice counts as far as its peaks fall off as they should, so that choices are chains that grow by a rank a round; the cross product of
the ranks' peaks is never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import shapes
from spectraloom.operators import graph

ION = ["scan", "line", "distribution", "analyte", "sequence", "charge", "ion"]
_PEAK = ["rank", "expected_mz", "mz", "abundance", "intensity", "place", "score"]


def leading(matches: DataFrame) -> DataFrame:
    """Matches of the ranks 0, 1, ... of each ion, up to the first rank that has none; `ranks` is their number."""
    ranks = matches.select(*ION, "rank").distinct().withColumn("_n", F.row_number().over(W.partitionBy(*ION).orderBy("rank")) - 1)
    whole = ranks.where("rank = _n").groupBy(*ION).agg(F.count("*").cast("int").alias("ranks"))
    return matches.join(whole, ION).where("rank < ranks")


def _falls(a: Column, b: Column) -> Column:
    """Whether intensities fall from a to b by more than the expected ratio and less than its square."""
    expected, seen = a["abundance"] / b["abundance"], a["intensity"] / b["intensity"]
    return (seen > expected) & (seen < expected * expected)


def chains(kept: DataFrame) -> DataFrame:
    """(ION, chain): choices of peaks of ranks 0 to m, m at least 1, that fall off as expected and cannot be told to go on: m is the last
    rank, or some peak of the next does not fall off from the last. That is what all combinations of one peak a rank come to.
    """
    peak = F.struct(*_PEAK)
    own = graph.settled(kept.select(*ION, "ranks", "rank", peak.alias("p")), "peaks")
    grown = own.where("rank = 0 AND ranks > 1").select(*ION, "ranks", F.array("p").alias("chain"), F.col("p").alias("last"))
    nexts = own.select(*ION, F.col("rank").alias("_at"), "p")
    done, m = None, 0
    while True:
        # Every next peak of a chain: it goes on with those that fit, and ends here for those that do not.
        met = grown.withColumn("_at", F.lit(m + 1)).join(nexts, [*ION, "_at"]).withColumn("fits", F.coalesce(_falls(F.col("last"), F.col("p")), F.lit(False)))
        met = graph.settled(met.select(*ION, "ranks", "chain", "p", "fits"), "chains")
        if m:
            ended = met.where("NOT fits").select(*ION, "chain").distinct()
            done = ended if done is None else done.unionByName(ended)
        grown = met.where("fits").select(*ION, "ranks", F.concat("chain", F.array("p")).alias("chain"), F.col("p").alias("last"))
        m += 1
        whole = grown.where(F.col("ranks") == m + 1).select(*ION, "chain")
        done = whole if done is None else done.unionByName(whole)
        grown = grown.where(F.col("ranks") > m + 1)
        if not met.head(1):
            return done


def choose(matches: DataFrame, averages: DataFrame) -> DataFrame:
    """(ION, value, peaks): for each ion the best choice of its isotopes' peaks, by rank.

    matches: ION, rank, expected_mz, mz, abundance, intensity, place (of the peak in its scan), score; abundances and intensities above 0. averages: (scan, average) intensity.
    Of chains the least product counts of how uneven their steps in m/z are and how far their shape is from the expected one; equal
    ones by their peaks. An ion of one rank takes the peak whose intensity is nearest the scan's average. An ion of several without a chain has no choice.
    """
    kept = graph.settled(leading(matches), "leading")
    each = chains(kept)
    steps = F.zip_with(F.slice("chain", 2, F.size("chain")), F.slice("chain", 1, F.size("chain") - 1), lambda b, a: b["mz"] - a["mz"])
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    each = each.withColumn("steps", steps).withColumn("mean", mean(F.col("steps")))
    uneven = mean(F.transform("steps", lambda x: F.abs(F.col("mean") - x)))
    shape = shapes.shape_deviation(F.transform("chain", lambda p: p["intensity"]), F.transform("chain", lambda p: p["abundance"]))
    several = each.select(*ION, F.struct((uneven * F.coalesce(shape, F.lit(0.0))).alias("value"), F.col("chain").alias("peaks")).alias("c"))
    lone = kept.where("ranks = 1").join(averages, "scan")
    lone = lone.select(*ION, F.struct(F.abs(F.col("average") - F.col("intensity")).alias("value"), F.array(F.struct(*_PEAK)).alias("peaks")).alias("c"))
    return several.unionByName(lone).groupBy(*ION).agg(F.min("c").alias("c")).select(*ION, "c.value", "c.peaks")


def counted(chosen: DataFrame) -> DataFrame:
    """(ION, rank, mz, ppm, intensity, place, score) of the chosen peaks that count: a peak of a scan counts for one ion of a sequence and analyte, the one of
    the least (value, ion, charge, line); an ion counts up to its first peak that counts elsewhere."""
    rows = chosen.select(*ION, "value", F.explode("peaks").alias("p"))
    own = W.partitionBy("sequence", "analyte", "scan", "p.place").orderBy("value", "ion", "charge", "line", "distribution", "p.rank")
    rows = rows.withColumn("lost", (F.row_number().over(own) > 1).cast("int"))
    upto = W.partitionBy(*ION).orderBy("p.rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("lost", F.max("lost").over(upto)).where("lost = 0")
    return rows.select(*ION, "p.rank", "p.mz", (F.abs(F.col("p.mz") - F.col("p.expected_mz")) / F.col("p.mz") * 1e6).alias("ppm"), "p.intensity", "p.place", "p.score")


def rankings(chosen: DataFrame) -> dict[str, DataFrame]:
    """Tables `scan`, `distribution` and `peptide`: ions, peaks, scores, deviations and intensities summed, and how the ions cut the sequence.

    Scans in which one ion alone was found do not count. Peptides are ranked within an analyte by coverage, then score, then name.
    """
    counts = [F.sum("score").alias("ion_score"), F.sum("ppm").alias("ppm"), F.sum("intensity").alias("intensity"), F.count("*").alias("n_peaks"), F.array_sort(F.collect_set("ion")).alias("ions")]
    rows = graph.settled(counted(chosen), "counted")
    told = lambda t: t.withColumn("geometry", shapes.geometry(F.col("sequence"), F.col("ions"))).select("*", "geometry.*").drop("geometry")
    places = F.array_join(F.transform(F.array_sort(F.collect_set("place")), lambda p: p.cast("string")), "/").alias("places")
    scans = rows.groupBy("sequence", "analyte", "distribution", "line", "scan").agg(*counts, places).where(F.size("ions") > 1)
    good = rows.join(scans.select("sequence", "analyte", "distribution", "line", "scan"), ["sequence", "analyte", "distribution", "line", "scan"], "left_semi")
    dists = good.groupBy("sequence", "analyte", "distribution").agg(*counts, F.countDistinct("scan").alias("n_scans"))
    peptides = told(good.groupBy("sequence", "analyte").agg(*counts, F.countDistinct("scan").alias("n_scans"), F.countDistinct("distribution").alias("n_distributions")))
    best = W.partitionBy("analyte").orderBy(F.desc(F.size("ions")), F.desc("ion_score"), "sequence")
    return {"scan": told(scans), "distribution": told(dists), "peptide": peptides.withColumn("place", F.row_number().over(best))}


def write_rankings(tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """Adds a run's tables to a folder of rankings, all or none: `<level>/run=<run>` for each, and `runs/run=<run>` at the end, without which the others do not count.

    A run that is written again, after a loss or on purpose, replaces its own rows alone.
    """
    counted_rows = []
    for level, rows in tables.items():
        path = f"{folder}/{level}/run={run}"
        rows.write.mode("overwrite").parquet(path)
        counted_rows.append((level, rows.sparkSession.read.schema(rows.schema).parquet(path).count()))
    spark: SparkSession = next(iter(tables.values())).sparkSession
    spark.createDataFrame(counted_rows, "level string, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={run}")


def read_rankings(spark: SparkSession, folder: str, level: str) -> DataFrame:
    """A level of all runs that were written whole, with `run`."""
    whole = spark.read.option("basePath", f"{folder}/runs").parquet(f"{folder}/runs").where(F.col("level") == level).select(F.col("run").cast("string").alias("run"))
    return spark.read.parquet(f"{folder}/{level}").withColumn("run", F.col("run").cast("string")).join(F.broadcast(whole), "run", "left_semi")
