"""What a file identified: scans, peptides with their best q-values, proteins with coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as C
from spectraloom.functions import scalars as S


def identified_scans(psm: DataFrame, q: str = "rescored_q", most: float = 0.001) -> DataFrame:
    """(filename, scan) with a PSM at or below the q-value; one without a q-value counts as identified."""
    value = S.to_double(F.col(q).cast("string"))
    return psm.where((F.coalesce(F.col("scan"), F.lit("")) != "") & F.coalesce(value <= most, F.lit(True))).select("filename", "scan").distinct()


def peptide_q(psm: DataFrame, q: str = "rescored_q", by_file: bool = True) -> DataFrame:
    """(filename, peptide_plain, q) or (peptide_plain, q): the least q-value, null where no PSM has one."""
    keys = ["filename", "peptide_plain"] if by_file else ["peptide_plain"]
    return psm.groupBy(*keys).agg(F.min(S.to_double(F.col(q).cast("string"))).alias("q"))


def places(sequence: Column, part: Column) -> Column:
    """Places (from 0) at which a part begins in a sequence, overlapping ones too; the part must be in it once at least."""
    count = F.regexp_count(sequence, F.concat(F.lit("(?="), part, F.lit(")")))
    # locate counts from 1; the last place found plus two is the next one to look from.
    step = lambda a: F.call_function("locate", part, sequence, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + 2) - 1
    return F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.array().cast("array<int>"), lambda a, _: F.concat(a, F.array(step(a))))


def spans(proteins: DataFrame, found: DataFrame, least: int = 7, most: int = 50) -> DataFrame:
    """(protein_id, peptide, start, end, q): every place of each identified peptide of a protein's digest.

    proteins: (protein_id, sequence); found: (peptide_plain, q).
    """
    cut = C.digest_rows(proteins, "protein_id", "sequence", least=least, most=most).select("protein_id", "peptide").distinct()
    met = cut.join(found.select(F.col("peptide_plain").alias("peptide"), "q"), "peptide").join(proteins.select("protein_id", "sequence"), "protein_id")
    at = met.select("protein_id", "peptide", "q", F.explode(places(F.col("sequence"), F.col("peptide"))).alias("start"))
    return at.select("protein_id", "peptide", "start", (F.col("start") + F.length("peptide")).alias("end"), "q")


def residue_q(placed: DataFrame) -> DataFrame:
    """(protein_id, residue, q): each covered residue with the least q-value of the peptides over it; null if none has one."""
    each = placed.select("protein_id", "q", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("residue"))
    return each.groupBy("protein_id", "residue").agg(F.min("q").alias("q"))


def coverage(proteins: DataFrame, placed: DataFrame) -> DataFrame:
    """(protein_id, length, covered, percent) of every protein; 0 without identified peptides."""
    hit = residue_q(placed).groupBy("protein_id").agg(F.count("*").alias("covered"))
    rows = proteins.select("protein_id", F.length("sequence").alias("length")).join(hit, "protein_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.withColumn("percent", F.when(F.col("length") > 0, 100.0 * F.col("covered") / F.col("length")).otherwise(0.0))


#: Metric -> (column of a protein row, what is missing counts as, whether less is better).
METRICS = {"coverage": ("percent", 0.0, False), "length": ("length", 0.0, False), "peptides": ("n_peptides", 0.0, False), "fdr": ("protein_q", 1.0, True), "psms": ("n_psms", 0.0, False)}


def protein_list(rows: DataFrame, most: float = 0.01, metric: str = "coverage", descending: bool = True) -> DataFrame:
    """Proteins at or below the q-value (those without one stay), the best by a metric first; ties go by id."""
    column, missing, less = METRICS[metric]
    q = S.to_double(F.col("protein_q").cast("string"))
    value = F.coalesce(F.col(column).cast("double"), F.lit(missing)) * (-1 if less else 1)
    kept = rows.where((F.coalesce(F.col("protein_id"), F.lit("")) != "") & F.coalesce(q <= most, F.lit(True)))
    return kept.withColumn("metric", value).orderBy(F.desc("metric") if descending else F.asc("metric"), "protein_id")
