"""Motif indexes as files: motifs.tsv, and postings.bin with a block of bytes for each motif.

A block is the number of proteins, the first id and the steps to each next one, as
variable-length integers: seven bits a byte, low ones first, the top bit set while more follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.operators.graph import settled

#: The columns of motifs.tsv.
FIELDS = "motif_id bigint, motif_text string, protein_count bigint, posting_offset bigint, posting_bytes bigint"


def _varint(v: Column) -> Column:
    """Hex of one integer of 0 or more."""
    more = F.floor((F.length(F.bin(v)) - 1) / 7).cast("int")  # groups of seven bits after the first
    byte = lambda i: F.call_function("shiftright", v, i * 7).bitwiseAND(F.lit(127)) + F.when(i < more, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), more), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def encoded(ids: Column) -> Column:
    """The block of an ascending array of ids of 0 or more; null for null, one byte 0 for an empty one."""
    steps = F.transform(ids, lambda v, i: v - F.when(i == 0, 0).otherwise(F.get(ids, i - 1)))
    return F.unhex(F.concat(_varint(F.size(ids).cast("long")), F.array_join(F.transform(steps, lambda v: _varint(v.cast("long"))), "")))


def decoded(block: bytes) -> list[int]:
    """The ids of a block; those that its count names, at most. An empty block has none."""
    raw = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if ends.size == 0:
        return []
    raw = raw[: ends[-1] + 1]
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(raw.size) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)
    return np.cumsum(values[1 : 1 + values[0]]).tolist()


def indexed(postings: DataFrame) -> DataFrame:
    """(motif_id, motif_text, protein_count, posting_offset, posting_bytes, block) of (motif_text, protein_id).

    Motifs are numbered from 0 by text; offsets are sums over the blocks before. Rows are cut into ranges of
    texts, so sums run within a range and over one row a range. Repeated rows and null ids count once and not at all.
    """
    lists = postings.where("motif_text IS NOT NULL AND protein_id IS NOT NULL").groupBy("motif_text").agg(F.array_sort(F.collect_set(F.col("protein_id").cast("long"))).alias("ids"))
    blocks = lists.select("motif_text", F.size("ids").cast("long").alias("protein_count"), encoded(F.col("ids")).alias("block")).withColumn("posting_bytes", F.length("block").cast("long"))
    ranged = settled(blocks.repartitionByRange("motif_text").withColumn("_range", F.spark_partition_id()), "blocks")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("posting_bytes").alias("size"))
    sums = sums.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_size"))
    within = W.partitionBy("_range").orderBy("motif_text")
    so_far = F.coalesce(F.sum("posting_bytes").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sums), "_range")
    return placed.select((F.col("_n") + F.row_number().over(within) - 1).alias("motif_id"), "motif_text", "protein_count", (F.col("_size") + so_far).alias("posting_offset"), "posting_bytes", "block")


def write_index(postings: DataFrame, folder: str) -> None:
    """Writes motifs.tsv and postings.bin into a folder of the driver: an export for viewers, one file each by
    format. Rows pass through the driver a partition at a time and are never held together."""
    rows = settled(indexed(postings), "index").repartitionByRange("motif_id").sortWithinPartitions("motif_id")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    with (target / "motifs.tsv").open("w", newline="") as motifs, (target / "postings.bin").open("wb") as blocks:
        motifs.write("\t".join(names) + "\n")
        for row in rows.toLocalIterator():
            motifs.write("\t".join(str(row[n]) for n in names) + "\n")
            blocks.write(row["block"])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(motif_id, motif_text, protein_count, ids) of an index in a folder that all executors see.

    Each task seeks the blocks of its motifs; no one reads the whole file. Motifs without a block have no ids.
    """
    motifs = spark.read.csv(f"{folder}/motifs.tsv", sep="\t", header=True, schema=FIELDS, quote="")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(f"{folder}/postings.bin", "rb") as blocks:
            for rows in frames:
                ids = []
                for offset, size in zip(rows["posting_offset"].fillna(0).astype(int), rows["posting_bytes"].fillna(0).astype(int)):
                    blocks.seek(offset)
                    ids.append(decoded(blocks.read(size) if size else b""))
                yield rows[["motif_id", "motif_text", "protein_count"]].assign(ids=ids)

    return motifs.mapInPandas(fetch, "motif_id bigint, motif_text string, protein_count bigint, ids array<bigint>")
