"""Distributions of adjacent charges that are one analyte: matches, runs of charges, and a competition for the distributions.

A distribution's base masses are its lines' masses without charge. Matches come from a band join on them; what is compared in a pair
or a run is a few lines, so that it is column arithmetic or a small group; the competition is that of `assembly.assemble`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions.scalars import PROTON
from spectraloom.operators import graph
from spectraloom.operators.assembly import assemble, mean_span, spans

#: Fixed value: share of time that two lines of one isotope must have in common, unless one encloses the other.
LEAST_MET = 0.5


def gathered(lines: DataFrame) -> DataFrame:
    """(file, dist, charge, members, start, end): members are (base, area, start, end) by mass.

    lines: (file, dist, charge, mean, area, start, end) of lines that are in a distribution of charge 1 or more.
    """
    base = (F.col("mean") - PROTON) * F.col("charge")
    member = F.struct(base.alias("base"), "area", "start", "end")
    return lines.where("dist IS NOT NULL AND charge >= 1").groupBy("file", "dist", "charge").agg(F.sort_array(F.collect_list(member)).alias("members"), F.min("start").alias("start"), F.max("end").alias("end"))


def tolerances(dists: DataFrame) -> DataFrame:
    """(file, charge, tolerance): how far the steps between base masses are from a proton's mass, on average over a file's distributions of a charge."""
    steps = F.transform(F.sequence(F.lit(1), F.size("members") - 1), lambda i: F.abs(F.lit(PROTON) - (F.get("members", i)["base"] - F.get("members", i - 1)["base"])))
    each = dists.where(F.size("members") > 1).select("file", "charge", F.explode(steps).alias("off"))
    return each.groupBy("file", "charge").agg(F.avg("off").alias("tolerance"))


def _closest(a: Column, b: Column) -> Column:
    """(gap, i, j) of the nearest two members; the first by i, then j."""
    return F.array_min(F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.struct(F.abs(x["base"] - y["base"]).alias("gap"), i.alias("i"), j.alias("j"))))))


def _met(a: Column, b: Column) -> Column:
    """Whether two lines' times agree: one within the other, or more than LEAST_MET of the time of both in common."""
    inside = ((a["start"] > b["start"]) & (a["end"] < b["end"])) | ((b["start"] > a["start"]) & (b["end"] < a["end"]))
    both = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return inside | (F.coalesce((F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])) / F.nullif(both, F.lit(0.0)), F.lit(0.0)) > LEAST_MET)


def _count(xs: Column, holds) -> Column:
    return F.size(F.filter(xs, holds))


def _order(members: Column) -> Column:
    """Places of the members from the largest area to the least; of equal ones the last first."""
    return F.transform(F.reverse(F.array_sort(F.transform(members, lambda m, i: F.struct(m["area"].alias("area"), i.alias("i"))))), lambda s: s["i"])


def alike(told: DataFrame, width: float) -> DataFrame:
    """(file, o, n): distributions of charges z and z + 1 whose times meet, some of their base masses at most z's tolerance apart. width: the largest tolerance.

    Ids and times alone meet, in cells of base mass and time; what the distributions hold joins the distinct pairs.
    """
    cell, span = lambda x: F.floor(x / F.lit(max(width, 1e-9))), mean_span(told)
    base = told.select("file", "charge", "dist", "tolerance", "start", "end", F.explode("members.base").alias("base")).withColumn("span", spans(F.col("start"), F.col("end"), span))
    o = base.where("tolerance IS NOT NULL").select(
        "file", (F.col("charge") + 1).alias("charge"), F.col("dist").alias("o"), F.col("tolerance").alias("t"), F.col("base").alias("x"), F.col("start").alias("s"), F.col("end").alias("e"), "span",
        F.explode(F.array(*[cell(F.col("base")) + k for k in (-1, 0, 1)])).alias("cell"),
    )
    n = base.select("file", "charge", F.col("dist").alias("n"), F.col("base").alias("y"), "start", "end", "span", cell(F.col("base")).alias("cell"))
    met = o.join(n.hint("merge"), ["file", "charge", "span", "cell"]).where((F.abs(F.col("x") - F.col("y")) <= F.col("t")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    return met.select("file", "o", "n").distinct()


def matches(dists: DataFrame) -> DataFrame:
    """(file, o, n): distributions of charges z and z + 1 that agree.

    Some base masses are at most z's tolerance apart, and their times meet. Laid over each other at their nearest masses, most lines that then face one agree
    in time; most of the smaller one's masses have one of the other's within the tolerance of z + 1; and the orders of their areas, from there on, differ
    by less than a place a line.
    """
    told = dists.join(tolerances(dists), ["file", "charge"], "left")
    width = told.agg(F.max("tolerance")).first()[0]
    if width is None:
        return dists.select("file", F.col("dist").alias("o"), F.col("dist").alias("n")).where("false")
    fields = F.struct("dist", "charge", "members", "start", "end", "tolerance")
    near = alike(told, float(width))
    side = lambda c, x: told.select("file", F.col("dist").alias(c), fields.alias(x))
    pair = near.join(side("o", "a"), ["file", "o"]).join(side("n", "b"), ["file", "n"])
    a, b = F.col("a.members"), F.col("b.members")
    # Written first: inlined, the nearest members would be sought again for each line that is looked at.
    pair = graph.settled(pair.withColumn("at", _closest(b, a)), "paired")
    shift = F.col("at.i") - F.col("at.j")  # a line k of a faces line k + shift of b
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size(a), F.size(b) - shift) - 1
    faced = F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda k: _met(F.get(a, k), F.get(b, k + shift)))
    pair = pair.withColumn("faced", faced).where(_count(F.col("faced"), lambda x: x) * 2 > F.size("faced"))
    within = lambda xs, ys: _count(xs, lambda x: F.exists(ys, lambda y: F.abs(x["base"] - y["base"]) < F.col("b.tolerance")))
    found = F.when(F.size(b) >= F.size(a), within(a, b)).otherwise(within(b, a))
    pair = pair.where(found * 2 > F.least(F.size(a), F.size(b)))
    low = F.least("at.i", "at.j")
    i, j = F.col("at.i") - low, F.col("at.j") - low
    long = F.least(F.size(b) - i, F.size(a) - j)
    apart = F.aggregate(F.zip_with(F.slice(_order(a), j + 1, long), F.slice(_order(b), i + 1, long), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return pair.where(apart <= long - 1).select("file", "o", "n")


def runs(dists: DataFrame, found: DataFrame) -> DataFrame:
    """(file, run, charges): of each group that matches link, every choice of one distribution a charge over two or more neighbouring charges that the group has.

    A run grows by a charge a round.
    """
    node = lambda c: F.struct("file", F.col(c).alias("dist"))
    linked = graph.components(found.select(node("o").alias("u"), node("n").alias("v")), "u", "v").select("id.file", "id.dist", F.col("component").alias("group"))
    layer = linked.join(dists.select("file", "dist", "charge"), ["file", "dist"]).withColumn("layer", F.dense_rank().over(W.partitionBy("group").orderBy("charge")))
    layer = graph.settled(layer.select("group", "file", "layer", "dist"), "layers")
    grown = layer.select("group", "file", "layer", F.array("dist").alias("run"))
    nexts = layer.select("group", (F.col("layer") - 1).alias("layer"), F.col("dist").alias("_next"))
    every = None
    while True:
        grown = grown.join(nexts, ["group", "layer"]).select("group", "file", (F.col("layer") + 1).alias("layer"), F.concat("run", F.array("_next")).alias("run"))
        grown = graph.settled(grown, "runs")
        every = grown if every is None else every.unionByName(grown)
        if not grown.head(1):
            return every.select("file", "run")


def scored(dists: DataFrame, every: DataFrame) -> DataFrame:
    """(file, run, intensity, mass, spread) of runs whose isotopes agree in time: at most of the places that several distributions hold, all their lines overlap.

    Distributions are laid over the longest (of several the one of the lowest charge) at their nearest base masses. intensity: how far a distribution's shares of
    the area at its places are from their mean; mass: how far base masses are from a place's mean; both averaged. spread: one over the mean of
    overlap over union of the pairs at a place that overlap.
    """
    own = dists.select("file", "dist", "members")
    part = every.select("file", "run", F.posexplode("run").alias("k", "dist")).join(own, ["file", "dist"])
    by = W.partitionBy("file", "run")
    longest = F.max(F.struct(F.size("members").alias("n"), (-F.col("k")).alias("k"), F.col("members").alias("m"))).over(by)
    part = part.withColumn("line_up", longest["m"]).withColumn("at", _closest(F.col("members"), F.col("line_up")))
    place = part.select("file", "run", "k", F.posexplode("members").alias("i", "m"), (F.col("at.j") - F.col("at.i")).alias("off"))
    place = place.select("file", "run", "k", (F.col("off") + F.col("i")).alias("place"), "m")
    here = W.partitionBy("file", "run", "place")
    place = place.withColumns({"n": F.count("*").over(here), "share": F.col("m.area") / F.sum("m.area").over(here), "off": F.abs(F.avg("m.base").over(here) - F.col("m.base"))}).where("n > 1")
    place = graph.settled(place.withColumn("uneven", F.abs(F.avg("share").over(W.partitionBy("file", "run", "k")) - F.col("share"))), "places")
    held = place.groupBy("file", "run", "place").agg((F.max("m.start") <= F.min("m.end")).alias("all_met"), F.sort_array(F.collect_list(F.struct("k", "m"))).alias("ms"), F.sum("off").alias("off"), F.sum("uneven").alias("uneven"), F.count("*").alias("n"))
    one = lambda x, y: (F.least(x["m"]["end"], y["m"]["end"]) - F.greatest(x["m"]["start"], y["m"]["start"])) / (F.greatest(x["m"]["end"], y["m"]["end"]) - F.least(x["m"]["start"], y["m"]["start"]))
    pairs = F.flatten(F.transform("ms", lambda x, i: F.transform(F.slice("ms", i + 2, F.size("ms")), lambda y: one(x, y))))
    held = held.withColumn("shared", F.filter(pairs, lambda x: x > 0))
    total = held.groupBy("file", "run").agg(
        F.sum(F.col("all_met").cast("int")).alias("met"), F.count("*").alias("places"), (F.sum("uneven") / F.sum("n")).alias("intensity"), (F.sum("off") / F.sum("n")).alias("mass"),
        F.sum(F.aggregate("shared", F.lit(0.0), lambda s, x: s + x)).alias("overlap"), F.sum(F.size("shared")).alias("overlaps"),
    )
    return total.where("met * 2 > places AND overlaps > 0").select("file", "run", "intensity", "mass", (F.col("overlaps") / F.col("overlap")).alias("spread"))


def ranked(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, pair, tier, value) of the neighbouring pairs of runs, for each run they are in, and the sets that runs allow.

    Tier 1: pairs at a distribution that is in several: the three scores as shares of the distribution's sums. Tier 2: others, by the first two scores.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.size("run") - 1), lambda i: F.struct(F.get("run", i - 1).alias("o"), F.get("run", i).alias("n"), F.lit(0).alias("charge")))
    each = good.select("file", "run", "intensity", "mass", "spread", F.explode(pairs).alias("pair"))
    ends = each.withColumn("dist", F.explode(F.array("pair.o", "pair.n")))
    whole = W.partitionBy("file", "dist")
    share = lambda c: F.col(c) / F.when(F.sum(c).over(whole) == 0, 1.0).otherwise(F.sum(c).over(whole))
    several = F.count("*").over(whole) > 1
    value = F.when(several, share("intensity") + share("mass") + share("spread")).otherwise(F.col("intensity") + F.col("mass"))
    ranks = ends.select("file", "run", "pair", F.when(several, 1).otherwise(2).alias("tier"), value.alias("value")).groupBy("file", "run", "pair").agg(F.min(F.struct("tier", "value")).alias("r"))
    allowed = good.select("file", F.array_sort("run").alias("lines")).distinct()
    return ranks.select("file", "pair", "r.tier", "r.value").distinct(), allowed


def analytes(lines: DataFrame) -> DataFrame:
    """(file, dist, analyte): the distributions that are one analyte at several charges get the least of their numbers; others their own.

    lines: (file, dist, charge, mean, area, start, end); rows without a distribution or a charge do not take part.
    """
    dists = graph.settled(gathered(lines), "gathered")
    found = graph.settled(matches(dists), "matches")
    good = graph.settled(scored(dists, runs(dists, found)), "good")
    got = assemble(*ranked(good))
    joined = got.select("file", F.col("line").alias("dist"), F.col("set").alias("_set"))
    return dists.select("file", "dist").join(joined, ["file", "dist"], "left").select("file", "dist", F.coalesce("_set", "dist").alias("analyte"))
