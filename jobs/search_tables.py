"""Turns the tables of a search and its rescoring into tables by run: PSMs, peptides, proteins, quantities, files.

    python -m jobs.search_tables --tables DIR --output OUT

The config names a file for each of the five inputs (Parquet, or what `format` says) and an expression for each column that the
readers of search results would give, so that any layout can be read. Written under OUT, as Parquet: `psms`, `quantities`,
`file_peptides` and `file_proteins`, partitioned by run; `peptides` and `proteins` of the whole search; `files`, a row
for each run with its counts, as JSON, too (`files_json`). The tables are the reorganisation's, under the names that its files have.

Each table replaces the one before, so that a run that was cut off is run again, and a repeated run leaves the same. Blank is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, config, logger, session
from spectraloom.functions import scalars as S
from spectraloom.operators import reorganize as R

NAME = "search_tables"
TABLES = ("psms", "quantities", "peptides", "proteins", "file_peptides", "file_proteins", "files")
BY_RUN = ("psms", "quantities", "file_peptides", "file_proteins")
#: The folder of rows whose run has no name; they count in the tables of the whole search.
NO_RUN = "_"


def inputs(spark: SparkSession, folder: str, conf: dict) -> dict[str, DataFrame]:
    found = {}
    for name, of in conf["tables"].items():
        rows = spark.read.format(of.get("format", "parquet")).options(**of.get("options", {})).load(f"{folder}/{of['path']}")
        found[name] = rows.selectExpr(*[f"{expression} AS `{column}`" for column, expression in of["columns"].items()])
    return found


def run(spark: SparkSession, folder: str, target: str, conf: dict) -> dict[str, DataFrame]:
    """Writes the tables and returns them, read back."""
    log, q = logger(NAME), conf["q_max"]
    given = inputs(spark, folder, conf)
    made: dict[str, DataFrame] = {}

    def put(name: str, rows: DataFrame) -> DataFrame:
        """The table as written; what is built on it reads that."""
        path = f"{target}/{name}"
        out = R.named(rows)
        if name in BY_RUN:
            # A run of very many rows is split among tasks and files.
            run_dir = F.coalesce(F.nullif(S.safe_dir_name(F.col("filename")), F.lit("")), F.lit(NO_RUN))
            out = out.withColumn("run_dir", run_dir).hint("rebalance", "run_dir")
        writer = out.write.mode("overwrite")
        (writer.partitionBy("run_dir") if name in BY_RUN else writer).parquet(path)
        made[name] = spark.read.schema(out.schema).parquet(path)
        log.info("wrote %d rows to %s", made[name].count(), path)
        return R.unnamed(made[name])

    for name, rows in given.items():
        log.info("reads %d columns of %s/%s for %s", len(rows.columns), folder, conf["tables"][name]["path"], name)
    psm = put("psms", R.psms(given["rescored_psms"], given["search"], q))
    quant = put("quantities", R.quantities(given["quantities"], q, conf["keep_zero_quantities"]))
    peptides = put("peptides", R.peptides(given["rescored_peptides"], psm, quant, q))
    proteins = put("proteins", R.proteins(given["rescored_proteins"], psm, q))
    of_file = put("file_peptides", R.file_peptides(psm, quant, peptides))
    its_proteins = put("file_proteins", R.file_proteins(psm, proteins))
    names = given["rescored_psms"].select("filename").union(given["rescored_peptides"].select("filename")).union(given["search"].select("filename"))
    put("files", R.file_summary(R.files(names.where("filename <> ''")), psm, of_file, its_proteins, quant))
    made["files"].write.mode("overwrite").json(f"{target}/files_json")
    return made


def main() -> None:
    args = command(NAME, "Reorganises the tables of a search by run.", {"tables": "folder of the inputs", "output": "folder of the tables"})
    spark = session(NAME)
    try:
        run(spark, args.tables, args.output, config(NAME, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
