"""Search and rescoring tables turned into PSM, peptide, protein and quantity tables.

Inputs are text tables (blank is missing). Groups are aggregated before they are joined, so each
join carries one row a key; lists keep distinct values in numeric-aware order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S

#: Search columns carried beside a PSM (name there, name here).
SEARCH_FIELDS = [
    ("spectrum_q", "search_spectrum_q"), ("peptide_q", "search_peptide_q"), ("protein_q", "search_protein_q"),
    ("sage_discriminant_score", "search_discriminant_score"), ("posterior_error", "search_posterior_error"),
    ("rank", "rank"), ("label", "label"), ("charge", "charge"), ("expmass", "exp_mass"), ("calcmass", "calc_mass"),
    ("precursor_ppm", "precursor_ppm"), ("fragment_ppm", "fragment_ppm"), ("rt", "rt"), ("aligned_rt", "aligned_rt"),
    ("predicted_rt", "predicted_rt"), ("delta_rt_model", "delta_rt_model"), ("hyperscore", "hyperscore"),
    ("delta_next", "delta_next"), ("delta_best", "delta_best"), ("matched_peaks", "matched_peaks"),
    ("matched_intensity_pct", "matched_intensity_pct"), ("ms2_intensity", "ms2_intensity"),
]
#: Columns of a quantity table that are not files.
LFQ_FIELDS = ["peptide", "charge", "proteins", "q_value", "score", "spectral_angle"]

#: Names that the files of results give to columns of these tables (name here, name there).
FILE_NAMES = {
    "rescored_score": "percolator_score", "rescored_q": "percolator_q", "rescored_pep": "percolator_pep", "best_rescored_q": "best_percolator_q", "best_rescored_score": "best_percolator_score",
    "n_rescored_peptides": "n_percolator_peptides", "search_spectrum_q": "sage_spectrum_q", "search_peptide_q": "sage_peptide_q", "search_protein_q": "sage_protein_q",
    "search_discriminant_score": "sage_discriminant_score", "search_posterior_error": "sage_posterior_error", "lfq_q": "sage_lfq_q", "lfq_score": "sage_lfq_score",
}


def named(rows: DataFrame) -> DataFrame:
    """A table of results under the names that its file has."""
    return rows.withColumnsRenamed(FILE_NAMES)


def unnamed(rows: DataFrame) -> DataFrame:
    """A table that was read from a file of results, under the names used here."""
    return rows.withColumnsRenamed({there: here for here, there in FILE_NAMES.items()})


def _or_blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _list(x: str, when: Column | None = None) -> Column:
    return S.join_unique(F.collect_set(F.col(x) if when is None else F.when(when, F.col(x))))


def _targets(rows: DataFrame, q: str, proteins: str, q_max: float) -> DataFrame:
    return rows.where(S.keep_q(F.col(f"`{q}`"), q_max) & ~S.is_decoy(F.col(proteins)))


def psms(rescored: DataFrame, search: DataFrame, q_max: float = 0.01) -> DataFrame:
    """Accepted target PSMs with their search rows (left join; of repeated psm_ids the last row by `_order` counts).

    `search` may carry `_order` (file position, as `read_tsv(order=True)` gives); without it the largest row in text order is taken.
    """
    kept = _targets(rescored, "q-value", "proteinIds", q_max)
    order = F.col("_order") if "_order" in search.columns else F.struct(*[F.col(c) for c in search.columns])
    fields = ["filename", "scannr", "proteins"] + [a for a, _ in SEARCH_FIELDS]
    row = F.struct(*[(F.col(c) if c in search.columns else F.lit("")).alias(c) for c in fields])
    last = search.groupBy(F.col("psm_id").alias("_id")).agg(F.max_by(row, order).alias("s"))
    j = kept.join(last, kept["PSMId"] == last["_id"], "left")
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    flanked = F.col("peptide")
    rows = j.select(
        either("filename", "s.filename").alias("filename"), _or_blank(S.scan_number(F.col("s.scannr"))).alias("scan"), _or_blank(F.col("s.scannr")).alias("scan_native"),
        F.col("PSMId").alias("psm_id"), S.strip_flanks(flanked).alias("peptide"), S.strip_mods(S.strip_flanks(flanked)).alias("peptide_plain"), flanked.alias("peptide_flanked"),
        S.left_flank(flanked).alias("flank_left"), S.right_flank(flanked).alias("flank_right"), either("proteinIds", "s.proteins").alias("proteins"),
        F.col("score").alias("rescored_score"), F.col("q-value").alias("rescored_q"), F.col("posterior_error_prob").alias("rescored_pep"),
        *[_or_blank(F.col(f"s.{a}")).alias(b) for a, b in SEARCH_FIELDS],
    )
    return rows.withColumns({"run_dir": S.safe_dir_name(F.col("filename")), "scan_key": S.scan_key(F.col("filename"), F.col("scan"))})


def quantities(lfq: DataFrame, q_max: float = 0.01, keep_zero: bool = False) -> DataFrame:
    """One row per (peptide, charge, file): the file columns unpivoted. Quantities of 0 go; blank ones stay."""
    files = [c for c in lfq.columns if c not in LFQ_FIELDS]
    long = _targets(lfq, "q_value", "proteins", q_max).unpivot(LFQ_FIELDS, [F.col(f"`{f}`") for f in files], "filename", "quantity")
    if not keep_zero:
        long = long.where(~F.coalesce(S.to_double(F.col("quantity")) == 0.0, F.lit(False)))
    return long.select(
        "filename", S.safe_dir_name(F.col("filename")).alias("run_dir"), "peptide", S.strip_mods(F.col("peptide")).alias("peptide_plain"), "charge", "proteins", "quantity",
        F.col("q_value").alias("lfq_q"), F.col("score").alias("lfq_score"), "spectral_angle",
    )


def peptides(rescored: DataFrame, psm: DataFrame, quant: DataFrame, q_max: float = 0.01) -> DataFrame:
    """Accepted peptides with counts and lists of their PSMs, and whether they were quantified."""
    linked = psm.groupBy("peptide").agg(
        F.count("*").alias("n_psms"), F.countDistinct(F.nullif("filename", F.lit(""))).alias("n_files"), _list("filename").alias("files"),
        _list("scan_key").alias("scan_keys"), _list("psm_id").alias("psm_ids"),
    )
    rows = _targets(rescored, "q-value", "proteinIds", q_max).select(
        S.strip_flanks(F.col("peptide")).alias("peptide"), S.strip_mods(S.strip_flanks(F.col("peptide"))).alias("peptide_plain"), F.col("peptide").alias("example_flanked_peptide"),
        F.col("proteinIds").alias("proteins"), F.col("PSMId").alias("best_psm_id"), F.col("filename").alias("best_filename"),
        F.col("score").alias("rescored_score"), F.col("q-value").alias("rescored_q"), F.col("posterior_error_prob").alias("rescored_pep"),
    )
    lfq = quant.select("peptide").distinct().withColumn("has_lfq", F.lit("1"))
    return _fill(rows.join(linked, "peptide", "left").join(lfq, "peptide", "left"), has_lfq="0")


def _fill(rows: DataFrame, **special: str) -> DataFrame:
    """Counts of nothing are 0, lists of nothing blank."""
    fill = {c: 0 if t in ("bigint", "int") else "" for c, t in rows.dtypes if t in ("bigint", "int", "string")}
    return rows.fillna(fill | special)


def _aliases(protein: Column) -> Column:
    """A protein's id and, of a list, every item."""
    return F.array_distinct(F.concat(F.array(protein), S.items(protein)))


def proteins(rescored: DataFrame, psm: DataFrame, q_max: float = 0.01) -> DataFrame:
    """Accepted proteins with the PSMs that name any of their aliases, each PSM once a protein."""
    kept = rescored.where(S.keep_q(F.col("`q-value`"), q_max) & ~S.is_decoy(F.col("ProteinId")))
    named = psm.select("psm_id", "filename", "scan_key", F.explode(F.array_distinct(S.items(F.col("proteins")))).alias("alias"))
    asked = kept.select("ProteinId", F.explode(_aliases(F.col("ProteinId"))).alias("alias")).distinct()
    met = asked.join(named, "alias").dropDuplicates(["ProteinId", "psm_id"])
    linked = met.groupBy("ProteinId").agg(
        F.count("*").alias("n_linked_psms"), F.countDistinct(F.nullif("filename", F.lit(""))).alias("n_files"), _list("filename").alias("files"),
        _list("scan_key").alias("scan_keys"), _list("psm_id").alias("psm_ids"),
    )
    its = S.items(F.col("peptideIds"))
    rows = kept.join(linked, "ProteinId", "left").select(
        F.col("ProteinId").alias("protein_id"), F.col("ProteinGroupId").alias("protein_group_id"), F.col("q-value").alias("rescored_q"), F.col("posterior_error_prob").alias("rescored_pep"),
        F.size(its).alias("n_rescored_peptides"), "n_linked_psms", "n_files", "files", "scan_keys", "psm_ids", F.array_join(its, ";").alias("peptides"),
    )
    return _fill(rows)


def file_peptides(psm: DataFrame, quant: DataFrame, global_peptides: DataFrame) -> DataFrame:
    """Per file, peptides of PSMs and of quantities (full outer), best scores from either or from the global row."""
    best = lambda f, x: f(S.to_double(F.col(x)))
    a = psm.groupBy("filename", "peptide").agg(
        F.count("*").alias("n_psms"), F.collect_set("proteins").alias("pa"), _list("scan").alias("scans"), _list("psm_id").alias("psm_ids"),
        best(F.min, "rescored_q").alias("q"), best(F.max, "rescored_score").alias("score"),
    )
    b = quant.groupBy("filename", "peptide").agg(
        F.collect_set("proteins").alias("pb"), _list("quantity").alias("quantities"), _list("charge").alias("charges"),
        best(F.min, "lfq_q").alias("lfq_q"), best(F.max, "lfq_score").alias("lfq_score"), best(F.max, "spectral_angle").alias("spectral_angle"),
    )
    g = global_peptides.groupBy("peptide").agg(F.max(F.struct(S.to_double(F.col("rescored_q")).alias("gq"), S.to_double(F.col("rescored_score")).alias("gs"))).alias("g"))
    none = F.array().cast("array<string>")
    rows = a.join(b, ["filename", "peptide"], "full_outer").join(g, "peptide", "left")
    return _fill(
        rows.select(
            "filename", "peptide", S.strip_mods(F.col("peptide")).alias("peptide_plain"),
            S.join_unique(F.concat(F.coalesce("pa", none), F.coalesce("pb", none))).alias("proteins"), "n_psms", "scans", "psm_ids",
            F.coalesce("q", "g.gq").alias("best_rescored_q"), F.coalesce("score", "g.gs").alias("best_rescored_score"), "quantities", "charges", "lfq_q", "lfq_score", "spectral_angle",
        )
    )


def file_proteins(psm: DataFrame, global_proteins: DataFrame) -> DataFrame:
    """Per file and protein named by a PSM: counts and lists, with the global row that has it as an alias.

    Of several the last counts: by `_order` where the rows have it, else by q-value (none or 0 as 1) and id, as the table of proteins is written.
    """
    its = psm.select("filename", "peptide", "scan", "psm_id", F.explode(S.items(F.col("proteins"))).alias("protein_id"))
    rows = its.groupBy("filename", "protein_id").agg(
        F.countDistinct(F.nullif("peptide", F.lit(""))).alias("n_peptides"), F.count("*").alias("n_psms"), _list("peptide").alias("peptides"), _list("scan").alias("scans"), _list("psm_id").alias("psm_ids")
    )
    worst = F.coalesce(F.nullif(S.to_double(F.col("rescored_q")), F.lit(0.0)), F.lit(1.0))
    order = F.col("_order") if "_order" in global_proteins.columns else F.struct(worst, "protein_id")
    known = global_proteins.select(F.explode(_aliases(F.col("protein_id"))).alias("alias"), F.struct("protein_id", "protein_group_id", "rescored_q", "rescored_pep").alias("g"), order.alias("o"))
    known = known.groupBy("alias").agg(F.max_by("g", "o").alias("g"))
    j = rows.join(known, rows["protein_id"] == known["alias"], "left")
    return _fill(j.select(*rows.columns, F.col("g.protein_group_id").alias("protein_group_id"), F.col("g.rescored_q").alias("protein_q"), F.col("g.rescored_pep").alias("protein_pep")))


def files(filenames: DataFrame) -> DataFrame:
    """The file dimension: folder, fraction and replicate from the name."""
    f = F.col("filename")
    return filenames.select("filename").distinct().select("filename", S.safe_dir_name(f).alias("run_dir"), S.fraction_name(f).alias("fraction"), S.replicate_name(f).alias("replicate"))


def file_summary(file_rows: DataFrame, psm: DataFrame, pep: DataFrame, prot: DataFrame, quant: DataFrame) -> DataFrame:
    """Row counts a file; files without rows stay with zeros."""
    out = file_rows
    counted = psm.groupBy("filename").agg(F.count("*").alias("n_psms"), F.countDistinct(F.nullif("scan", F.lit(""))).alias("n_scans"))
    for part in (counted, *[t.groupBy("filename").agg(F.count("*").alias(n)) for t, n in ((pep, "n_peptides"), (prot, "n_proteins"), (quant, "n_quant_rows"))]):
        out = out.join(part, "filename", "left")
    return _fill(out)


def flank_lookup(peptide_proteins: DataFrame, digest: DataFrame) -> DataFrame:
    """Flanks of each (peptide, protein): from the digest of that protein, else of any, with a status saying which.

    `digest` is (protein, peptide, left_flank, right_flank); of several places the first by protein and flanks counts.
    """
    flanks = F.struct("protein", "left_flank", "right_flank")
    own = digest.groupBy("protein", "peptide").agg(F.min(flanks).alias("own"))
    any_ = digest.groupBy("peptide").agg(F.min(flanks).alias("other"))
    j = peptide_proteins.join(own, ["protein", "peptide"], "left").join(any_, "peptide", "left")
    pick = F.coalesce("own", "other")
    status = F.when(F.col("own").isNotNull(), "protein").when(F.col("other").isNotNull(), "peptide").otherwise("missing")
    return j.select("peptide", "protein", _or_blank(pick["left_flank"]).alias("left_flank"), _or_blank(pick["right_flank"]).alias("right_flank"), status.alias("status"))


def first_by_alias(proteins_: DataFrame, alias: Column, order: Column) -> DataFrame:
    """alias -> sequence; where several entries share an alias the first in order wins."""
    rows = proteins_.select(F.explode(alias).alias("alias"), "sequence", order.alias("_o"))
    return rows.groupBy("alias").agg(F.min_by("sequence", "_o").alias("sequence"))


def identified(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key was identified: a semi-join."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def best_file(psm: DataFrame) -> DataFrame:
    """Per plain peptide the file with the smallest q-value (nulls last, then name), and that q."""
    q = S.to_double(F.col("rescored_q"))
    first = W.partitionBy("peptide_plain").orderBy(q.asc_nulls_last(), "filename")
    return psm.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("peptide_plain", "filename", q.alias("q"))
