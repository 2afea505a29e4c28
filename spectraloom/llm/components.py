"""Connected components of an edge table, without collecting edges or neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import dropped, written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge (a, b); component is its smallest node.

    Edges lead from the larger to the smaller node. In every round each node keeps one edge, to the smallest it has (its
    parent) or to the parent's parent if there is one; its other edges go from their ends to its parent. So trees
    of parents stay whole, their depth halves, and trees that an edge ties become one. Each round is a minimum by node,
    summed on the map side, and joins with that written table, which Spark may split at a node of very many
    edges. Self-loops and repeated edges do no harm.
    """
    now = written(_down(edges.select("a", "b")), "edges")
    for _ in range(rounds):
        least = written(now.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        before = _state(least.select("a", F.col("m").alias("b")))
        single = not least.where("n > 1").head(1)
        up = least.select(F.col("a").alias("m"), F.col("m").alias("up"))
        step = least.join(up, "m", "left").select("a", F.coalesce("up", "m").alias("b"))
        if not single:
            more = now.join(least.where("n > 1").select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            step = step.unionByName(more).distinct()
        past, now = now, written(step, "edges")
        dropped(past, least)
        if single and _state(now) == before:
            # Every edge now leads to the smallest node of its component.
            found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return found.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once each."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
