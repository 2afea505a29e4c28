"""The jobs as queries: each runs twice into a new folder and returns its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common, peptide_index, search_tables
from spectraloom.operators.graph import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_peptide_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new and leaves the index as it is. A stream takes a single file by a pattern alone."""
    out = _folder(spark, "job1")
    for _ in range(2):
        index = peptide_index.run(spark, f"{sf_dir}/document[s].parquet", f"{out}/index", f"{out}/checkpoint", common.config(peptide_index.NAME))
    return index.select(F.col("id").alias("doc_id"), "peptide", "n_places", "first_start", F.col("length").cast("long").alias("length"))


JOB1_SQL = """
WITH s AS (SELECT row_number() OVER () AS r, doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents),
x AS (SELECT r, i AS cut FROM (SELECT r, q, unnest(range(1, length(q))) AS i FROM s) WHERE substr(q, i, 1) IN ('K', 'R') AND substr(q, i + 1, 1) <> 'P'
  UNION ALL SELECT r, 0 FROM s WHERE q <> '' UNION ALL SELECT r, length(q) FROM s WHERE q <> ''),
o AS (SELECT r, cut, row_number() OVER (PARTITION BY r ORDER BY cut) AS n FROM x),
p AS (SELECT s.doc_id, a.cut AS start, substr(s.q, a.cut + 1, b.cut - a.cut) AS peptide
  FROM o a JOIN o b ON a.r = b.r AND b.n - a.n BETWEEN 1 AND 3 JOIN s ON s.r = a.r WHERE b.cut - a.cut BETWEEN 7 AND 50)
SELECT doc_id, peptide, CAST(count(*) AS BIGINT) AS n_places, CAST(min(start) AS BIGINT) AS first_start, CAST(length(peptide) AS BIGINT) AS length FROM p GROUP BY doc_id, peptide
"""


#: Columns of each table, without the run's folder.
COLUMNS = {
    "psms": "charge filename flank_left flank_right hyperscore peptide peptide_flanked peptide_plain percolator_pep percolator_q percolator_score proteins psm_id rank sage_spectrum_q scan scan_key scan_native",
    "quantities": "charge filename peptide peptide_plain proteins quantity sage_lfq_q sage_lfq_score spectral_angle",
    "peptides": "best_filename best_psm_id example_flanked_peptide files has_lfq n_files n_psms peptide peptide_plain percolator_pep percolator_q percolator_score proteins psm_ids scan_keys",
    "proteins": "files n_files n_linked_psms n_percolator_peptides peptides percolator_pep percolator_q protein_group_id protein_id psm_ids scan_keys",
    "file_peptides": "best_percolator_q best_percolator_score charges filename n_psms peptide peptide_plain proteins psm_ids quantities sage_lfq_q sage_lfq_score scans spectral_angle",
    "file_proteins": "filename n_peptides n_psms peptides protein_group_id protein_id protein_pep protein_q psm_ids scans",
    "files": "filename fraction n_peptides n_proteins n_psms n_quant_rows n_scans replicate",
}


def job2_search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven tables after the second run, a text of its columns for each row."""
    out = _folder(spark, "job2")
    for _ in range(2):
        made = search_tables.run(spark, sf_dir, out, common.config(search_tables.NAME))
    rows = None
    for name, columns in COLUMNS.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.split()])
        run = F.col("run_dir") if "run_dir" in made[name].columns else F.lit("")
        one = made[name].select(F.lit(name).alias("table_name"), run.alias("run_dir"), text.alias("row_text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _given(name: str) -> str:
    of = common.config(search_tables.NAME)["tables"][name]
    return f"SELECT {', '.join(f'{e} AS "{c}"' for c, e in of['columns'].items())} FROM {of['path'].removesuffix('.parquet')}"


def _list(x: str) -> str:
    """Distinct values that are not blank, whole numbers first by size."""
    whole = f"regexp_matches({x}, '^[0-9]+$')"
    keyed = f"list({{'text': NOT {whole}, 'number': CASE WHEN {whole} THEN TRY_CAST({x} AS HUGEINT) END, 'value': {x}}}) FILTER ({x} <> '')"
    return f"coalesce(array_to_string(list_transform(list_sort(list_distinct({keyed})), lambda s: s.value), ';'), '')"


def _items(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[;, ]+'), lambda i: i <> '')"


def _number(x: str) -> str:
    return f"TRY_CAST(nullif(trim({x}), '') AS DOUBLE)"


def _kept(q: str, proteins: str) -> str:
    return f"{_number(q)} <= 6 AND len(list_filter({_items(proteins)}, lambda p: starts_with(p, 'decoy_'))) = 0"


def _inner(p: str) -> str:
    return f"CASE WHEN length({p}) >= 5 AND substr({p}, 2, 1) = '.' AND substr({p}, length({p}) - 1, 1) = '.' THEN substr({p}, 3, length({p}) - 4) ELSE {p} END"


def _plain(p: str) -> str:
    return f"regexp_replace(regexp_replace({p}, '\\[[^\\]]*\\]', '', 'g'), '[^A-Z]', '', 'g')"


def _run(f: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({f}, '(\\.centroid)?\\.mz(ML|ml)$', ''), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), '_')"


def _texts(name: str) -> str:
    run = "run_dir" if name in (*search_tables.BY_RUN, "files") else "''"
    return f"SELECT '{name}' AS table_name, {run} AS run_dir, concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in COLUMNS[name].split())}) AS row_text FROM {name}"


_FILES = ["run_F_NaCl_1.centroid.mzML", "run_O_NaCl_3.centroid.mzML"]
JOB2_SQL = f"""
WITH rescored AS ({_given("rescored_psms")}), search AS ({_given("search")}), of_peptides AS ({_given("rescored_peptides")}), of_proteins AS ({_given("rescored_proteins")}), wide AS ({_given("quantities")}),
last AS (SELECT * FROM search QUALIFY row_number() OVER (PARTITION BY psm_id ORDER BY _order DESC) = 1),
linked AS (SELECT r.PSMId AS psm_id, coalesce(nullif(r.filename, ''), s.filename, '') AS filename, coalesce(s.scannr, '') AS scan_native,
    coalesce(nullif(regexp_extract(s.scannr, 'scan=(\\d+)', 1), ''), s.scannr, '') AS scan, r.peptide AS peptide_flanked, {_inner("r.peptide")} AS peptide,
    substr(r.peptide, 1, 1) AS flank_left, substr(r.peptide, length(r.peptide), 1) AS flank_right, r.proteinIds AS proteins, r.score AS percolator_score, r."q-value" AS percolator_q,
    r.posterior_error_prob AS percolator_pep, '' AS sage_spectrum_q, coalesce(s.rank, '') AS rank, coalesce(s.charge, '') AS charge, coalesce(s.hyperscore, '') AS hyperscore
  FROM rescored r LEFT JOIN last s ON r.PSMId = s.psm_id WHERE {_kept('r."q-value"', "r.proteinIds")}),
psms AS (SELECT *, {_plain("peptide")} AS peptide_plain, {_run("filename")} AS run_dir, filename || ':scan=' || scan AS scan_key FROM linked),
long AS ({" UNION ALL ".join(f"""SELECT *, '{f}' AS filename, "{f}" AS quantity FROM wide""" for f in _FILES)}),
quantities AS (SELECT filename, {_run("filename")} AS run_dir, peptide, {_plain("peptide")} AS peptide_plain, charge, proteins, quantity, q_value AS sage_lfq_q, score AS sage_lfq_score, spectral_angle
  FROM long WHERE {_kept("q_value", "proteins")} AND coalesce({_number("quantity")}, 1) <> 0),
by_peptide AS (SELECT peptide, count(*) AS n_psms, count(DISTINCT nullif(filename, '')) AS n_files, {_list("filename")} AS files, {_list("scan_key")} AS scan_keys, {_list("psm_id")} AS psm_ids FROM psms GROUP BY peptide),
peptides AS (SELECT p.*, coalesce(n_psms, 0) AS n_psms, coalesce(n_files, 0) AS n_files, coalesce(files, '') AS files, coalesce(scan_keys, '') AS scan_keys, coalesce(psm_ids, '') AS psm_ids,
    CASE WHEN p.peptide IN (SELECT peptide FROM quantities) THEN '1' ELSE '0' END AS has_lfq
  FROM (SELECT {_inner("peptide")} AS peptide, {_plain(_inner("peptide"))} AS peptide_plain, peptide AS example_flanked_peptide, proteinIds AS proteins, PSMId AS best_psm_id, filename AS best_filename,
      score AS percolator_score, "q-value" AS percolator_q, posterior_error_prob AS percolator_pep FROM of_peptides WHERE {_kept('"q-value"', "proteinIds")}) p LEFT JOIN by_peptide USING (peptide)),
named AS (SELECT psm_id, filename, scan_key, unnest(list_distinct({_items("proteins")})) AS alias FROM psms),
asked AS (SELECT ProteinId, unnest(list_distinct(list_prepend(ProteinId, {_items("ProteinId")}))) AS alias FROM of_proteins WHERE {_kept('"q-value"', "ProteinId")}),
met AS (SELECT DISTINCT ProteinId, psm_id, filename, scan_key FROM asked JOIN named USING (alias)),
by_protein AS (SELECT ProteinId, count(*) AS n_linked_psms, count(DISTINCT nullif(filename, '')) AS n_files, {_list("filename")} AS files, {_list("scan_key")} AS scan_keys, {_list("psm_id")} AS psm_ids FROM met GROUP BY 1),
proteins AS (SELECT p.ProteinId AS protein_id, ProteinGroupId AS protein_group_id, "q-value" AS percolator_q, posterior_error_prob AS percolator_pep, len({_items("peptideIds")}) AS n_percolator_peptides,
    coalesce(n_linked_psms, 0) AS n_linked_psms, coalesce(n_files, 0) AS n_files, coalesce(files, '') AS files, coalesce(scan_keys, '') AS scan_keys, coalesce(psm_ids, '') AS psm_ids,
    array_to_string({_items("peptideIds")}, ';') AS peptides
  FROM of_proteins p LEFT JOIN by_protein b ON p.ProteinId = b.ProteinId WHERE {_kept('"q-value"', "p.ProteinId")}),
a AS (SELECT filename, peptide, count(*) AS n_psms, list(proteins) AS pa, {_list("scan")} AS scans, {_list("psm_id")} AS psm_ids, min({_number("percolator_q")}) AS q, max({_number("percolator_score")}) AS score FROM psms GROUP BY 1, 2),
b AS (SELECT filename, peptide, list(proteins) AS pb, {_list("quantity")} AS quantities, {_list("charge")} AS charges, min({_number("sage_lfq_q")}) AS sage_lfq_q, max({_number("sage_lfq_score")}) AS sage_lfq_score,
    max({_number("spectral_angle")}) AS spectral_angle FROM quantities GROUP BY 1, 2),
g AS (SELECT peptide, {_number("percolator_q")} AS gq, {_number("percolator_score")} AS gs FROM peptides),
joined AS (SELECT coalesce(a.filename, b.filename) AS filename, coalesce(a.peptide, b.peptide) AS peptide, list_concat(coalesce(pa, []), coalesce(pb, [])) AS ps, * EXCLUDE (filename, peptide) FROM a FULL JOIN b ON a.filename = b.filename AND a.peptide = b.peptide),
file_peptides AS (SELECT filename, {_run("filename")} AS run_dir, peptide, {_plain("peptide")} AS peptide_plain, array_to_string(list_sort(list_distinct(list_filter(ps, lambda p: p <> ''))), ';') AS proteins,
    coalesce(n_psms, 0) AS n_psms, coalesce(scans, '') AS scans, coalesce(psm_ids, '') AS psm_ids, coalesce(q, gq) AS best_percolator_q, coalesce(score, gs) AS best_percolator_score, coalesce(quantities, '') AS quantities,
    coalesce(charges, '') AS charges, sage_lfq_q, sage_lfq_score, spectral_angle FROM joined LEFT JOIN g USING (peptide)),
each AS (SELECT filename, peptide, scan, psm_id, unnest({_items("proteins")}) AS protein_id FROM psms),
known AS (SELECT unnest(list_distinct(list_prepend(protein_id, {_items("protein_id")}))) AS alias, * FROM proteins),
best AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY alias ORDER BY coalesce(nullif({_number("percolator_q")}, 0), 1) DESC, protein_id DESC) = 1),
file_proteins AS (SELECT e.*, {_run("e.filename")} AS run_dir, coalesce(protein_group_id, '') AS protein_group_id, coalesce(percolator_q, '') AS protein_q, coalesce(percolator_pep, '') AS protein_pep
  FROM (SELECT filename, protein_id, count(DISTINCT nullif(peptide, '')) AS n_peptides, count(*) AS n_psms, {_list("peptide")} AS peptides, {_list("scan")} AS scans, {_list("psm_id")} AS psm_ids FROM each GROUP BY 1, 2) e
  LEFT JOIN best ON e.protein_id = best.alias),
runs AS (SELECT DISTINCT filename FROM (SELECT filename FROM rescored UNION ALL SELECT filename FROM of_peptides UNION ALL SELECT filename FROM search) WHERE filename <> ''),
files AS (SELECT r.filename, CASE WHEN contains(r.filename, '_GuHCl_') THEN 'GuHCl' WHEN contains(r.filename, '_NaCl_') THEN 'NaCl' ELSE '' END AS fraction, regexp_extract(r.filename, '_(\\d+)(?:_|\\.centroid)', 1) AS replicate, {_run("r.filename")} AS run_dir,
    (SELECT count(*) FROM psms p WHERE p.filename = r.filename) AS n_psms, (SELECT count(DISTINCT nullif(scan, '')) FROM psms p WHERE p.filename = r.filename) AS n_scans,
    (SELECT count(*) FROM file_peptides p WHERE p.filename = r.filename) AS n_peptides, (SELECT count(*) FROM file_proteins p WHERE p.filename = r.filename) AS n_proteins,
    (SELECT count(*) FROM quantities p WHERE p.filename = r.filename) AS n_quant_rows FROM runs r)
{" UNION ALL ".join(_texts(name) for name in COLUMNS)}
"""

QUERIES = {"job1_peptide_index": job1_peptide_index, "job2_search_tables": job2_search_tables}
ORACLES = {"job1_peptide_index": JOB1_SQL, "job2_search_tables": JOB2_SQL}
