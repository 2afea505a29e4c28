"""Gapped motifs (fixed residues and dots) mined from protein windows, and their look-ups.

A node is a motif text with the places that it must not fix. The windows that match it need no
list of their own: they carry the node's text, so every level is grouping and joining, and a node's
support is the summed size of the distinct sequence groups among them. Texts with k letters have at
most round((k - 2) * specificity) levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.operators.graph import settled

#: Residues that no window may hold, and the order of sources.
EXCLUDED = "BJOXZU"
SOURCE_RANK = {"SwissProt": 0, "TrEMBL": 1}


def representatives(proteins: DataFrame, source: str | None = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of equal sequences: (gid, sequence, n) and (protein_id, gid).

    `gid` is the protein_id of the least (source rank, accession, protein_id). Groups are
    found by a 128-bit hash, so sequences move only once.
    """
    rank = F.coalesce(*[F.when(F.col(source) == s, r) for s, r in SOURCE_RANK.items()], F.lit(2)) if source else F.lit(0)
    rows = proteins.where(F.length("sequence") > 0).withColumns({"_h": F.md5("sequence"), "_o": F.struct(rank.alias("r"), F.col("accession").alias("a"), F.col("protein_id").alias("p"))})
    groups = rows.groupBy("_h").agg(F.min("_o.p").alias("_any"), F.min("_o").alias("_o"), F.count("*").alias("n"), F.first("sequence").alias("sequence"))
    named = groups.select("_h", F.col("_o.p").alias("gid"), "sequence", "n")
    return named.drop("_h"), rows.select("protein_id", "_h").join(named.select("_h", "gid"), "_h").drop("_h")


def windows(groups: DataFrame, least: int = 5, most: int = 12, excluded: str = EXCLUDED) -> DataFrame:
    """Distinct (gid, n, k, win): windows of every length without an excluded residue (either case).

    Sequences are cut at excluded residues first, so only valid windows are made.
    """
    runs = groups.select("gid", "n", F.explode(F.filter(F.split("sequence", f"[*{excluded}{excluded.lower()}]"), lambda r: F.length(r) >= least)).alias("run"))
    sized = runs.withColumn("k", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("run")))))
    cut = F.transform(F.sequence(F.lit(1), F.length("run") - F.col("k") + 1), lambda i: F.substr("run", i, F.col("k")))
    return sized.select("gid", "n", "k", F.explode(F.array_distinct(cut)).alias("win")).distinct()


def budget(k: int, specificity: float) -> int:
    """Inner places that a motif may fix; halves round up."""
    return 0 if k <= 2 else min(k - 2, math.floor((k - 2) * specificity + 0.5))


def mine(wins: DataFrame, k: int, specificity: float = 0.35) -> DataFrame:
    """(motif_text, gid, n): motifs of k letters with the sequence groups that hold them.

    At each node, places are split by residue; residues with enough support stay, and places
    whose residues cover enough of the node compete by (coverage, new children, children). All
    of the best places go on, but a later one never fixes an earlier tied place again. A node
    without such a place, or with its budget spent, is a motif.
    """
    inner = budget(k, specificity)
    first = F.concat(F.substring("win", 1, 1), F.lit("." * (k - 2)), F.substring("win", k, 1))
    live = wins.where(F.col("k") == k).select("gid", "n", "win", first.alias("motif_text"), F.lit("").alias("blocked"))
    node = ["motif_text", "blocked"]
    done = None
    for fixed in range(inner):
        live = settled(live, f"motif-{k}-{fixed}")
        support = live.dropDuplicates([*node, "gid"]).groupBy(*node).agg(F.sum("n").alias("parent"))
        least = F.greatest(F.lit(1), F.ceil(F.col("parent") * F.lit(specificity * ((fixed + 1) / inner))))
        place = F.explode(F.sequence(F.lit(2), F.lit(k - 1)))
        free = (F.substr("motif_text", F.col("p"), F.lit(1)) == ".") & ~F.contains("blocked", F.chr(F.col("p") + 64))
        # A place is one letter of `blocked`: chr(64 + p).
        cells = live.select(*node, "gid", "n", "win", place.alias("p")).where(free).select(*node, "gid", "n", "p", F.substr("win", F.col("p"), F.lit(1)).alias("aa")).distinct()
        child = cells.groupBy(*node, "p", "aa").agg(F.sum("n").alias("size")).join(support, node).where(F.col("size") >= least)
        child = settled(child, f"child-{k}-{fixed}")
        covered = cells.join(child.select(*node, "p", "aa"), [*node, "p", "aa"]).select(*node, "p", "gid", "n").distinct().groupBy(*node, "p").agg(F.sum("n").alias("covered"))
        scored = child.groupBy(*node, "p", "parent").agg(F.count("*").alias("total"), F.sum((F.col("size") < F.col("parent")).cast("int")).alias("fresh")).join(covered, [*node, "p"])
        scored = scored.where(F.col("covered") >= F.ceil(F.col("parent") * F.lit(1.0 - specificity)))
        # At most k - 2 places a node share its window.
        best = scored.withColumn("r", F.rank().over(W.partitionBy(*node).orderBy(F.desc("covered"), F.desc("fresh"), F.desc("total")))).where("r = 1").select(*node, "p")
        before = F.collect_list("p").over(W.partitionBy(*node).orderBy("p").rowsBetween(W.unboundedPreceding, -1))
        best = settled(best.withColumn("more", F.array_join(F.transform(before, lambda q: F.chr(q + 64)), "")), f"best-{k}-{fixed}")
        ended = live.join(best.select(*node).distinct(), node, "left_anti").select("motif_text", "gid", "n")
        done = ended if done is None else done.unionByName(ended)
        steps = child.select(*node, "p", "aa").join(best, [*node, "p"])
        text = F.concat(F.substr("motif_text", F.lit(1), F.col("p") - 1), "aa", F.substr("motif_text", F.col("p") + 1, F.lit(k)))
        letters = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.concat("blocked", "more"), ""), lambda c: c != ""))), "")
        on = live.join(steps, node).where(F.substr("win", F.col("p"), F.lit(1)) == F.col("aa"))
        live = on.select("gid", "n", "win", text.alias("motif_text"), letters.alias("blocked")).distinct()
    last = live.select("motif_text", "gid", "n")
    return (last if done is None else done.unionByName(last)).distinct()


def mine_all(wins: DataFrame, least: int = 5, most: int = 12, specificity: float = 0.35) -> DataFrame:
    found = [mine(wins, k, specificity) for k in range(least, most + 1)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def counts(found: DataFrame) -> DataFrame:
    """(motif_text, protein_count)."""
    return found.groupBy("motif_text").agg(F.sum("n").alias("protein_count"))


def postings(found: DataFrame, members: DataFrame) -> DataFrame:
    """(motif_text, protein_id), a row each: both look-ups filter this table."""
    return found.select("motif_text", "gid").join(members, "gid").select("motif_text", "protein_id")


def quantify(post: DataFrame, protein_quantity: DataFrame) -> DataFrame:
    """(motif_text, file, quantity): sums over the member proteins' quantities."""
    return post.join(protein_quantity, "protein_id").groupBy("motif_text", "file").agg(F.sum("quantity").alias("quantity"))


def positional_bias(motifs: DataFrame, bins: int = 10, weight: Column | None = None) -> DataFrame:
    """(bin, observed, expected, z): where motifs fix inner places, against places fixed at random in each.

    Only motifs that fix an inner place count; bins cut the inner places evenly.
    """
    k = F.length("motif_text")
    m = F.length(F.regexp_replace(F.substr("motif_text", F.lit(2), k - 2), r"\.", ""))
    rows = motifs.where(k > 2).select("motif_text", (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), (k - 2).alias("slots"), m.alias("m")).where("m > 0")
    cells = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    share = F.col("m") / F.col("slots")
    hit = F.substr("motif_text", F.col("i") + 2, F.lit(1)) != "."
    by = cells.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("i") / F.col("slots") * bins)).cast("int").alias("bin"))
    sums = by.agg(F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("observed"), F.sum(F.col("w") * share).alias("expected"), F.sum(F.col("w") * F.col("w") * share * (1 - share)).alias("var"))
    return sums.select("bin", "observed", "expected", F.when(F.col("var") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("var")).otherwise(0.0).alias("z"))


def mirror_imbalance(motifs: DataFrame) -> DataFrame:
    """One row: fixed inner places left and right of the middle, and their difference over their sum."""
    k = F.length("motif_text")
    cells = motifs.where(k > 2).select("motif_text", k.alias("k"), F.explode(F.sequence(F.lit(1), k - 2)).alias("i")).where("substr(motif_text, i + 1, 1) <> '.'")
    side = F.signum(F.col("i") - (F.col("k") - 1) / 2)
    sums = cells.agg(F.count(F.when(side < 0, 1)).alias("left"), F.count(F.when(side > 0, 1)).alias("right"), F.count(F.when(side == 0, 1)).alias("center"))
    both = F.col("left") + F.col("right")
    return sums.withColumn("imbalance", F.when(both > 0, (F.col("left") - F.col("right")) / both).otherwise(0.0))
