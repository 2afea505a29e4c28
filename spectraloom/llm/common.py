"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that words and lines are cut at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of a batch of rows that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BY_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset and everything runs on one machine (a local master, as in tests), a
    temporary folder that is then set as the checkpoint folder. A cluster without the setting raises.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spectraloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold BATCH_BYTES at most, unless it already has a bound below that.

    The session's own bounds, 10,000 rows and 64 MB, are held by a worker several times over.
    """
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BY_BYTES))
    if held > BATCH_BYTES:
        spark.conf.set(_BY_BYTES, str(BATCH_BYTES))


#: What `fresh_path` gave out and nothing has deleted yet, by session.
_made: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def _delete(path: str) -> None:
    context = _made.pop(path).sparkContext
    if context._jsc is not None:  # else it was stopped
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for table in tables:
        _delete(table._written)


@atexit.register
def release(spark: SparkSession | None = None) -> None:
    """Deletes what the operators left in the shared folder for their results, of a session or of all; those can no longer be read.

    Called at the end of the driver, too.
    """
    for path, made_by in list(_made.items()):
        if spark is None or spark is made_by:
            _delete(path)


def long_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as longs; ids of a type that is not integral raise, as a cast would lose them."""
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise ValueError(f"{id_col} must be integral, it is {kind}")
    return F.col(f"`{id_col}`").cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is. Pure ASCII text takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def free_name(df: DataFrame, *names: str) -> None:
    """Raises where an operator's required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of the frame has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
