"""Connected components and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the session's checkpoint folder.

    Where neither is set, a temporary one, on a local master alone; a cluster without the setting raises.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spectraloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Tables that `settled` wrote, by path; results read them until the session ends.
_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: no lineage behind them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    made = rows.sparkSession.read.schema(rows.schema).parquet(path)
    made._settled = path
    return made


def dropped(rows: DataFrame) -> None:
    """Deletes a table that `settled` wrote and nothing reads any more."""
    _delete(rows._settled)


def _delete(path: str) -> None:
    context = _written.pop(path).sparkContext
    if context._jsc is not None:  # else it was stopped
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def release(spark: SparkSession | None = None) -> None:
    """Deletes the settled tables of a session, or of all; frames that read them can no longer be used. Called at the driver's end, too."""
    for path, owner in list(_written.items()):
        if spark is None or owner is spark:
            _delete(path)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component): each node that has an edge, with the smallest node that it reaches.

    Nodes of one label take the least label among all their neighbours' and then the label of that label, so that both the
    sets and the distances of a chain shrink from round to round. Every round is three joins on labels and a minimum
    by node and by label, by exchange; nothing is collected but one count. Raises if labels still move after `rounds`.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = settled(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    own = edges.select(F.col(a).alias("id")).union(edges.select(F.col(b).alias("id"))).where("id IS NOT NULL").distinct()
    labels = settled(own.withColumn("component", F.col("id")), "labels")
    for _ in range(rounds):
        offered = both.join(labels.hint("merge"), both["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("low"))
        met = labels.join(offered.hint("merge"), labels["id"] == offered["u"], "left").select("id", F.col("component").alias("before"), F.least("component", "low").alias("own"))
        least = met.groupBy("before").agg(F.min("own").alias("now"))
        met = met.join(least.hint("merge"), "before").select("id", "before", "now")
        up = met.select(F.col("id").alias("now"), F.col("now").alias("above"))
        after = settled(met.join(up.hint("merge"), "now").select("id", "before", F.least("now", "above").alias("component")), "labels")
        moved = after.where("component < before").limit(1).count()
        labels = after.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 1000) -> DataFrame:
    """(start, node, depth): every node that a start leads to along edges (a, b), itself included, with the fewest steps to it.

    edges: (a, b); starts: (start). A round is a join of the nodes that are new with the edges, and an anti join with all that were met; both are tables.
    A start of very many nodes is dealt by node. Raises if there are new nodes after `rounds`.
    """
    steps = settled(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "steps")
    front = settled(starts.where("start IS NOT NULL").select("start", F.col("start").alias("node")).distinct(), "front")
    met = front.withColumn("depth", F.lit(0))
    for depth in range(1, rounds + 1):
        found = front.join(steps, front["node"] == steps["a"]).select("start", F.col("b").alias("node")).distinct()
        front = settled(found.join(met, ["start", "node"], "left_anti"), "front")
        if not front.head(1):
            return met
        met = met.unionByName(front.withColumn("depth", F.lit(depth)))
    raise RuntimeError(f"nodes are still new after {rounds} rounds")
