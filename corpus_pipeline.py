"""A corpus pipeline: five stages, each calling one operator of spectraloom.llm.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a frame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of `documents`.

In every stage a null text counts as an empty one and a null id as no document of its own (it is never
rejected as a copy); repeated rows are treated alike, each on its own; an empty table gives an empty one;
columns beside those of `documents`, of whatever names, pass through to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, crf, lines, mixing, partenum
from spectraloom.llm.common import own_names, written

#: Documents below this chance of being good are rejected.
LEAST_QUALITY = 0.3
#: Words in a shingle, per cent of similarity, and how often mixing may use a document.
SHINGLE, PERCENT, MOST_REPEATS = 5, 80, 1.5

#: The stages' results depend on learnt weights and hashes, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~crf.held_out("doc_id"))
    (score,) = own_names(docs, "_score")
    scored = crf.score_documents(docs, crf.train(docs, labels), score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; n_chars follows the text."""
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    aside = dict(zip(clash, own_names(docs, *[f"_{c}" for c in clash])))
    kept = lines.dedup_lines(docs.withColumnsRenamed(aside))
    kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that five-word shingles link at 0.8 or more."""
    return partenum.drop_near_duplicates(docs, SHINGLE, PERCENT).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources as even as MOST_REPEATS uses of a document allow; every document is used at least once, a row for each use."""
    return mixing.mix(docs, max_repeats=MOST_REPEATS).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids (packed little-endian 32-bit) in place of the text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
