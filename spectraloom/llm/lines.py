"""Line dedup: lines that several documents share stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import ASCII_SPACE, ascii_lower, free_name, written


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drops repeated lines; native plan, 128-bit keys, positions put the rest together again.

    A line's key is the stripped line with A-Z lower-cased. Keys of at least
    `min_chars` code points that at least `min_docs` documents hold lose all their
    lines, except those of the smallest document id that holds them.

    Returns the input's columns, with the text replaced by what is kept, and
    `n_lines` (before), `n_dropped`. Input columns of these two names give way; any other name
    may be among the input's.

    A null or empty text has one empty line. Rows with the same id are one document;
    each keeps its own text. A row with a null id is no document: it counts nowhere and
    keeps all its lines. An empty table gives an empty table.

    (id, row, position, key) are written once. Documents are counted by key on the map side. Keys
    held by several are written before the lines are joined with them, so that Spark may split
    a very common key's lines among tasks. Texts move once.
    """
    free_name(docs, id_col, text_col)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The input's columns travel in a struct: no name of theirs can clash.
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest if c != text_col], F.lit(0).alias("")).alias("_in"),
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(text).alias("_row"),
        F.split(text, "\n").alias("_lines"),
    )
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(ASCII_SPACE)))
    lines = (
        whole.where("_id IS NOT NULL")
        .select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_row", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"))
    )
    lines = written(lines, "lines")
    if min_docs <= 2:  # the extremes tell two documents from one without a distinct count
        held = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        held = held.where(F.col("_first") != F.col("_last")) if min_docs == 2 else held
    else:
        held = lines.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        held = held.where(F.col("_n") >= min_docs)
    held = written(held.select("_h1", "_h2", "_first"), "held")
    dropped = lines.join(held, ["_h1", "_h2"]).where(F.col("_id") != F.col("_first")).groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
    drop = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    made = [kept.alias("_kept"), F.size("_lines").cast("long").alias("_n"), F.size(drop).cast("long").alias("_dropped")]
    out = whole.join(dropped, ["_id", "_row"], "left").select("_in", *made)
    columns = [F.col("_kept").alias(c) if c == text_col else F.col("_in")[c].alias(c) for c in rest]
    return out.select(*columns, F.col("_n").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
