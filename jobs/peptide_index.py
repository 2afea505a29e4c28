"""Keeps a peptide index of a growing sequence library: each run digests the entries that are new.

    python -m jobs.peptide_index --entries DIR/documents.parquet --output OUT --checkpoint STATE

Entries are rows of Parquet files (a folder, or a pattern of files or folders), an id and a text whose letters are the sequence. A file stream takes the files that
the checkpoint has not seen, until none is left, and ends. A batch of files becomes the folder `batch=<n>` of the output,
partitioned by the peptides' length: (id, peptide, n_places, first_start), a row for each peptide of an id. A run that
was cut off repeats its last batch, over the same files, and replaces that folder. Output and checkpoint belong
together: they are kept, moved or removed as one.

A null or empty text has no peptides; a null id is an id of its own. Rows that share an id add up within a batch; a later batch
gives an id rows of its own. A run without new files writes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import command, config, logger, session
from spectraloom.functions import chemistry

NAME = "peptide_index"
#: Letters that a task digests: a few dozen MB of peptides, written in a file for each length.
LETTERS = 1 << 24


def _counted(sequence: str, conf: dict) -> dict[int, dict[str, list[int]]]:
    """By length, the peptides of a sequence with their places and the first of them."""
    pieces, start, found = [x for x in re.split(chemistry.TRYPSIN, sequence) if x], 0, {}
    for i, piece in enumerate(pieces):
        for m in range(conf["missed_cleavages"] + 1):
            peptide = "".join(pieces[i : i + m + 1])
            if i + m < len(pieces) and conf["least_length"] <= len(peptide) <= conf["most_length"]:
                found.setdefault(len(peptide), {}).setdefault(peptide, [0, start])[0] += 1
        start += len(piece)
    return found


def digest(entries: DataFrame, conf: dict) -> DataFrame:
    """(id, length, found) of a batch of entries; found: (peptide, n_places, first_start) of that id and length.

    Peptides of an entry are made and counted in its row, and leave it in a list for each length. Only those of ids that other entries of the batch have, too, are summed by exchange.
    """
    rows = entries.select(F.col(conf["id"]).alias("id"), F.upper(F.regexp_replace(F.col(conf["text"]), "[^A-Za-z]", "")).alias("sequence"))
    one = T.ArrayType(T.StructType([T.StructField("peptide", T.StringType()), T.StructField("n_places", T.LongType()), T.StructField("first_start", T.LongType())]))
    lists = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("found", one)]))

    @F.udf(lists, useArrow=True)
    def counted(sequence):
        return [(length, [(p, *x) for p, x in own.items()]) for length, own in _counted(sequence or "", conf).items()]

    shared = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("of"))
    # Texts are dealt among tasks first: a file of one row group is one task else. Peptides are many times a text, and stay where they are made.
    letters = entries.agg(F.sum(F.length(conf["text"]))).first()[0] or 0
    most = entries.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(max(1, -(-letters // LETTERS), min(most, 16 * letters // LETTERS)), "id", "sequence")
    each = lambda how: dealt.join(shared, dealt["id"].eqNullSafe(shared["of"]), how).select("id", F.inline(counted("sequence")))
    summed = each("left_semi").select("id", "length", F.inline("found")).groupBy("id", "length", "peptide").agg(F.sum("n_places").alias("n_places"), F.min("first_start").alias("first_start"))
    again = summed.select("id", "length", F.array(F.struct("peptide", "n_places", "first_start")).alias("found"))
    return each("left_anti").unionByName(again)


def output(spark: SparkSession, target: str, kind: T.DataType) -> DataFrame:
    """The whole index as it stands."""
    fields = [("id", kind), ("peptide", T.StringType()), ("n_places", T.LongType()), ("first_start", T.LongType()), ("batch", T.LongType()), ("length", T.IntegerType())]
    return spark.read.schema(T.StructType([T.StructField(*f) for f in fields])).parquet(target)


def run(spark: SparkSession, entries: str, target: str, checkpoint: str, conf: dict) -> DataFrame:
    """Takes what is new into the index and returns the whole of it."""
    log = logger(NAME)
    columns = spark.read.parquet(entries).select(conf["id"], conf["text"]).schema
    read = []

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        path = f"{target}/batch={number}"
        digest(batch, conf).select("id", F.inline("found"), "length").write.mode("overwrite").partitionBy("length").parquet(path)
        kind = columns[conf["id"]].dataType
        written = own.read.schema(T.StructType([T.StructField("id", kind), T.StructField("length", T.IntegerType())])).parquet(path).count()
        read.append(batch.count())  # of the files' footers
        log.info("batch %d: read %d entries, wrote %d peptides to %s", number, read[-1], written, path)

    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", conf["files_a_batch"]).parquet(entries)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d entries that were new in %s", sum(read), entries)
    return output(spark, target, columns[conf["id"]].dataType)


def main() -> None:
    args = command(NAME, "Digests new entries of a sequence library into a peptide index.", {"entries": "Parquet of entries", "output": "folder of the index", "checkpoint": "folder of the stream's state"})
    spark = session(NAME)
    try:
        run(spark, args.entries, args.output, args.checkpoint, config(NAME, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
