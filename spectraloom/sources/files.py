"""Readers and writers of the text formats around a search: TSV, JSON, FASTA, PIN, design files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """All columns as text, blank instead of null. Only the header is read to plan.

    With `order` a column `_order` beside them: by file, then by row within a file (its splits are read as
    partitions in ascending order), so that operators that keep the last of several rows can tell it.
    """
    rows = spark.read.csv(path, sep="\t", header=True, quote="", nullValue=None)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns], *[place.alias("_order")] * order)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value of any kind; null for null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, accession, source, sequence) of every entry with a sequence, upper-cased.

    An entry is one record of the text source, split at `>` where a line begins, so a large
    file is read in pieces. `sp|ACC|…` is SwissProt, `tr|ACC|…` TrEMBL, all else Other.
    """
    entries = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"))
    # The header ends with its line; wrapped sequence lines are joined.
    header = F.trim(F.regexp_replace(F.regexp_extract("value", r"^([^\n]*)", 1), "\r", ""))
    body = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", ""))
    token = F.regexp_extract("header", r"^(\S*)", 1)
    parts = F.split("token", r"\|")
    rows = entries.select(header.alias("header"), body.alias("sequence")).where("sequence <> ''").withColumn("token", token)
    piped = F.size(parts) >= 2
    source = F.when(piped & (F.get(parts, F.lit(0)) == "sp"), "SwissProt").when(piped & (F.get(parts, F.lit(0)) == "tr"), "TrEMBL").otherwise("Other")
    accession = F.when(piped, F.get(parts, F.lit(1))).otherwise(F.col("token"))
    return rows.select("header", accession.alias("accession"), source.alias("source"), "sequence")


def protein_keys(header: Column) -> Column:
    """Every name that a FASTA header answers to: itself, its first word, that word's parts."""
    first = F.regexp_extract(header, r"^(\S*)", 1)
    return F.array_distinct(F.concat(F.array(header, first), F.split(first, r"\|")))


def keep_sources(proteins: DataFrame, trembl: bool = False, other: bool = False) -> DataFrame:
    """SwissProt always, the other sources on request; none left is an error of the job that reads them."""
    wanted = ["SwissProt"] + ["TrEMBL"] * trembl + ["Other"] * other
    return proteins.where(F.col("source").isin(wanted))


def with_decoys(proteins: DataFrame, tag: str = "decoy_") -> DataFrame:
    """Targets and, for each, its reversed sequence under a tagged header."""
    decoys = proteins.withColumns({"header": F.concat(F.lit(tag), "header"), "accession": F.concat(F.lit(tag), "accession"), "sequence": F.reverse("sequence")})
    return proteins.unionByName(decoys)


def read_pin(spark: SparkSession, path: str) -> DataFrame:
    """(peptide, proteins) of a PIN file: the column Peptide or peptide, and all fields after it as proteins.

    Files are ragged, so lines are cut rather than parsed as a table; each file's own header
    says where its peptide stands.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    fields = F.split("value", "\t")
    is_header = F.exists(fields, lambda f: F.lower(f) == "peptide")
    at = F.array_position(F.transform(fields, F.lower), "peptide")
    heads = lines.where(is_header).groupBy("file").agg(F.min(at).alias("at"))
    rows = lines.where(~is_header & (F.trim("value") != "")).join(heads, "file").withColumn("f", fields)
    proteins = F.filter(F.slice("f", F.col("at").cast("int") + 1, F.greatest(F.size("f"), F.lit(1))), lambda p: F.trim(p) != "")
    return rows.select(F.col("file").alias("pin"), F.get("f", F.col("at").cast("int") - 1).alias("peptide"), proteins.alias("proteins"))


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """An experimental design: filename and any categories, comma or tab, trimmed; `file_key` to join by.

    The delimiter is the one that the header line holds.
    """
    head = spark.read.text(path).limit(1).first()
    sep = "\t" if head is None or "\t" in head.value else ","
    rows = spark.read.csv(path, sep=sep, header=True)
    rows = rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for c in rows.columns])
    return rows.where("filename <> ''").withColumn("file_key", file_key(F.col("filename")))


def file_key(name: Column) -> Column:
    """Lower-cased stem: no folders, no spectrum suffixes."""
    return F.regexp_replace(F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1)), r"(\.centroid)?\.(mzml|raw|sqlite|db)$", "")


def write_tsv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The named fields, in order; fields that the rows lack are blank, others are left out."""
    have = set(rows.columns)
    rows.select(*[(F.col(f).cast("string") if f in have else F.lit("")).alias(f) for f in fields]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_by_file(rows: DataFrame, path: str, key: str = "run_dir") -> None:
    """One folder a run; rows are brought together by run first, so no task writes to all folders."""
    rows.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def write_fasta(proteins: DataFrame, path: str, width: int = 60) -> None:
    body = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    proteins.select(F.concat(F.lit(">"), "header", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, tables: dict[str, str]) -> str:
    """JSON of each table's path and row count (counts come from Parquet footers)."""
    counts = {name: {"path": path, "rows": spark.read.parquet(path).count()} for name, path in tables.items()}
    return json.dumps(counts, indent=1, sort_keys=True)


#: Motif index: text, number of proteins, ids of the proteins that hold it.
MOTIFS = T.StructType([T.StructField("motif_text", T.StringType()), T.StructField("protein_count", T.LongType()), T.StructField("postings", T.ArrayType(T.LongType()))])


def links(html: Column, suffixes: Sequence[str] = ()) -> Column:
    """Distinct sorted link targets of a page, without fragments, that end in one of the suffixes (or all)."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"""href\s*=\s*["']([^"'#]+)"""), F.lit(1)), lambda u: F.trim(u))
    if suffixes:
        found = F.filter(found, lambda u: F.lower(u).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return F.array_sort(F.array_distinct(found))


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def resolve(base: Column, href: Column) -> Column:
    """The address that a page's link means, without its fragment; `.` and `..` in the path are followed. Null for a base without a host.

    A link may have a scheme, begin with a host (//), at the root (/), with a query (?) or beside the page.
    """
    root = F.nullif(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("/"))
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    absolute = (
        F.when(link.rlike(_SCHEME), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")) | (link == ""), F.concat(root, path, link))
        .otherwise(F.concat(root, folder, link))
    )
    host = F.regexp_extract(absolute, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    rest = F.regexp_extract(absolute, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?]*)", 1)
    query = F.regexp_extract(absolute, r"(\?.*)$", 1)
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    parts = F.split(F.regexp_replace(rest, "^/", ""), "/")
    walked = F.aggregate(parts, none, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    # A path that ends in a dot segment is a folder.
    ending = F.when(rest.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    tidy = F.when(rest.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(F.concat(F.lit("/"), F.array_join(walked, "/"), ending), "^//$", "/")).otherwise(rest)
    return F.when(host == "", F.when(absolute.rlike(_SCHEME), absolute)).otherwise(F.concat(host, tidy, query))


def folder_of(url: Column) -> Column:
    """The folder that an address lies in, without the slash at its end; the host for one at the root."""
    plain = F.regexp_replace(url, "[?#].*$", "")
    return F.when(plain.rlike("://[^/]*/"), F.regexp_replace(plain, "/[^/]*$", "")).otherwise(plain)
