"""SQLite stores of single files: a reader of their tables and a writer of one database a file.

A database is held in a task's memory while it is read or written: nothing lies in local folders. It must
thus be of a file's size; rows stream past it.
"""

from __future__ import annotations

import json
import sqlite3
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.sources.shared import located, replaced

#: Number formats of arrays in blobs, which are deflated.
BLOBS = {"double": "<f4", "float": "<f4", "bigint": "<i4", "int": "<i4"}
TYPES = {"string": "TEXT", "double": "REAL", "float": "REAL", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER"}
#: Rows put into a table at once.
BATCH = 50_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _element(field: T.StructField) -> str | None:
    return field.dataType.elementType.simpleString() if isinstance(field.dataType, T.ArrayType) else None


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """(file, columns of the schema) of a table in every database that the path names; arrays are read from blobs.

    A database without the table has no rows; a column that it lacks is an error of the job that reads it.
    """
    fields = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    blobs = [BLOBS.get(_element(f) or "") for f in fields]
    asked = ", ".join(_quoted(f.name) for f in fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                store, at = located(uri)
                con = sqlite3.connect(":memory:")
                with store.open_input_stream(at, compression=None) as f:
                    con.deserialize(f.read())
                if not con.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (table,)).fetchone():
                    continue
                rows = con.execute(f"SELECT {asked} FROM {_quoted(table)}")
                while some := rows.fetchmany(10_000):
                    columns = {"file": uri}
                    for f, kind, values in zip(fields, blobs, zip(*some)):
                        told = [None if v is None else np.frombuffer(zlib.decompress(v), kind) for v in values] if kind else list(values)
                        columns[f.name] = pd.Series(told, dtype=object)
                    yield pd.DataFrame(columns, index=range(len(some)))
                con.close()

    found = spark.read.format("binaryFile").load(path).select("path")
    return found.repartition("path").mapInPandas(read, T.StructType([T.StructField("file", T.StringType()), *fields]))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, scan, rt, mz, intensity): scans with their arrays of points; null arrays where a store keeps none of a scan."""
    scans = read_table(spark, path, "scans", "ms1_index long, rt double").withColumnRenamed("ms1_index", "scan")
    kept = read_table(spark, path, "scan_points", "ms1_index long, mz array<float>, intensity array<float>").withColumnRenamed("ms1_index", "scan")
    kept = kept.withColumns({c: F.col(c).cast("array<double>") for c in ("mz", "intensity")})
    return scans.join(kept, ["file", "scan"], "left").select("file", "scan", "rt", "mz", "intensity")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value): the settings that a store was made with, values as JSON text."""
    return read_table(spark, path, "parameters", "key string, value string")


def write_stores(tables: dict[str, DataFrame], path: str, key: str = "file_id", index: dict[str, list[str]] | None = None) -> DataFrame:
    """One database a value of the key, `path/<value>.sqlite`, with the tables without that column; (key, path, rows) of each.

    Numbers and texts are kept as they are, NaN as null, arrays as deflated blobs (doubles as 4-byte floats). `index` names columns
    by table. Tables of a file go to one task, in order and in batches; a file is put in place whole, so a lost task
    leaves none half written. Rows without a key are an error. The databases are written when the result is read.
    """
    order = {name: i for i, name in enumerate(tables)}
    fields = {name: [f for f in rows.schema if f.name != key] for name, rows in tables.items()}
    both = None
    for name, rows in tables.items():
        whole = F.coalesce(F.col(f"`{key}`").cast("string"), F.raise_error(F.lit(f"a row of {name} has no {key}")))
        row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields[name]]), {"ignoreNullFields": "false"})
        one = rows.select(whole.alias("key"), F.lit(order[name]).alias("table"), row.alias("row"))
        both = one if both is None else both.unionByName(one)
    names, indexes = list(tables), index or {}
    made = []
    for name in names:
        columns = ", ".join(f"{_quoted(f.name)} {'BLOB' if _element(f) else TYPES.get(f.dataType.simpleString(), 'TEXT')}" for f in fields[name])
        made.append(f"CREATE TABLE {_quoted(name)} ({columns})")
    after = [f"CREATE INDEX {_quoted(f'{name}_{c}')} ON {_quoted(name)} ({_quoted(c)})" for name, cs in indexes.items() for c in cs]
    kinds = {name: [BLOBS.get(_element(f) or "", "") for f in fields[name]] for name in names}
    real = {name: [f.dataType.simpleString() in ("double", "float") for f in fields[name]] for name in names}
    labels = {name: [f.name for f in fields[name]] for name in names}

    def value(v, kind: str, is_real: bool):
        if v is None or (is_real and isinstance(v, str) and v == "NaN"):
            return None
        if kind:
            return zlib.compress(np.array([np.nan if x is None else float(x) for x in v] if kind == "<f4" else v, kind).tobytes())
        return float(v) if is_real else json.dumps(v) if isinstance(v, dict | list) else v

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for file, own in groupby(rows, key=lambda r: r.key):
            con, n = sqlite3.connect(":memory:"), 0
            for sql in made:
                con.execute(sql)
            for place, some in groupby(own, key=lambda r: r.table):
                name = names[place]
                put = f"INSERT INTO {_quoted(name)} VALUES ({', '.join('?' * len(labels[name]))})"
                waiting = []
                for r in some:
                    told = json.loads(r.row)
                    waiting.append([value(told.get(c), k, d) for c, k, d in zip(labels[name], kinds[name], real[name])])
                    n += 1
                    if len(waiting) == BATCH:
                        con.executemany(put, waiting)
                        waiting = []
                con.executemany(put, waiting)
            for sql in after:
                con.execute(sql)
            con.commit()
            target = f"{path.rstrip('/')}/{file}.sqlite"
            with replaced(target, str(TaskContext.get().taskAttemptId())) as out:
                out.write(con.serialize())
            con.close()
            yield pd.DataFrame({key: [file], "path": [target], "rows": [n]})

    dealt = both.repartition("key").sortWithinPartitions("key", "table")
    return dealt.mapInPandas(write, T.StructType([T.StructField(key, T.StringType()), T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())]))
