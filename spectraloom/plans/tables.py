"""Quantities, designs and identifications on stand-in tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import identify, quantify
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}

#: Line items as quantities: a part is a peptide, flag, status and line number make a file, the supplier (and for large lots the next) the proteins.
QUANT = """
WITH quant AS (SELECT 'P' || l_partkey AS peptide, l_returnflag || l_linestatus || '_' || l_linenumber AS filename, CASE WHEN l_quantity < 1.5 THEN NULL ELSE l_extendedprice END AS quantity,
  'S' || l_suppkey || CASE WHEN l_quantity > 25 THEN '; S' || (l_suppkey + 1) ELSE '' END AS proteins, l_orderkey, l_linenumber, l_returnflag AS condition, l_linestatus AS batch FROM lineitem),
m AS (SELECT peptide, filename, condition, batch, sum(quantity) AS quantity FROM quant WHERE quantity IS NOT NULL GROUP BY 1, 2, 3, 4),
firsts AS (SELECT peptide, arg_min(proteins, l_orderkey * 10 + l_linenumber) AS proteins FROM quant WHERE quantity IS NOT NULL GROUP BY 1),
uniq AS (SELECT peptide, proteins AS protein FROM firsts WHERE proteins NOT LIKE '%;%')
"""


def _quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    more = F.when(F.col("l_quantity") > 25, F.concat(F.lit("; S"), (F.col("l_suppkey") + 1).cast("string"))).otherwise("")
    return l.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("peptide"), F.concat("l_returnflag", "l_linestatus", F.lit("_"), F.col("l_linenumber").cast("string")).alias("filename"),
        F.when(F.col("l_quantity") < 1.5, None).otherwise(F.col("l_extendedprice")).alias("quantity"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), more).alias("proteins"),
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("batch"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("stands"),
    )


def _matrix(rows: DataFrame) -> DataFrame:
    return quantify.feature_by_file(rows.withColumn("file", F.struct("filename", "condition", "batch")), "peptide", "file", "quantity").select("peptide", "file.*", "quantity")


def _unique(rows: DataFrame) -> DataFrame:
    # Of line items of one order and number the first in the table counts; those without order, number or supplier do not.
    rows = rows.withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber")).where("quantity IS NOT NULL AND proteins IS NOT NULL AND place IS NOT NULL")
    return quantify.unique_features(rows, "peptide", "proteins", F.struct("place", "stands"))


def query(sql: str | None, start: str = QUANT):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = start + sql
        return f

    return add


@query("SELECT peptide, protein FROM uniq")
def a07_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(_quant(spark, sf_dir))


@query("SELECT protein, filename, round(sum(quantity), 2) AS quantity FROM m JOIN uniq USING (peptide) GROUP BY 1, 2")
def a08_protein_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quant(spark, sf_dir)
    return quantify.protein_by_file(_matrix(rows), _unique(rows), "peptide", "filename").withColumn("quantity", F.round("quantity", 2))


@query("SELECT peptide, filename, round(sum(coalesce(quantity, 0)), 2) AS quantity FROM quant WHERE peptide IN ('P3', 'P44') GROUP BY 1, 2")
def a09_quantities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two peptides: what is asked for."""
    return quantify.quantities_of(_quant(spark, sf_dir), "peptide", "filename", "quantity", "P3", "P44").withColumn("quantity", F.round("quantity", 2))


@query("SELECT condition AS filename, CAST(count(*) AS BIGINT) AS n, round(sum(quantity), 2) AS quantity FROM quant WHERE condition IN ('A', 'N') GROUP BY 1")
def a10_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quant(spark, sf_dir)
    both = quantify.tagged_union({c: rows.where(F.col("condition") == c).drop("filename") for c in ("A", "N")})
    return both.groupBy("filename").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("SELECT peptide, condition, round(avg(log2(q)), 4) AS mean_log FROM (SELECT peptide, condition, batch, avg(quantity) AS q FROM m WHERE quantity > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def a14_replicate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.group_means(_matrix(_quant(spark, sf_dir)), "peptide", [F.col("condition")], [F.col("batch")]).withColumn("mean_log", F.round("mean_log", 4))


@query("""SELECT peptide, round(avg(CASE WHEN condition = 'A' AND batch = 'F' AND quantity > 0 THEN quantity END), 4) AS a_f, round(avg(CASE WHEN condition = 'N' AND batch = 'O' AND quantity > 0 THEN quantity END), 4) AS n_o,
  round(avg(CASE WHEN condition = 'R' AND batch = 'F' AND quantity > 0 THEN quantity END), 4) AS r_f FROM m GROUP BY 1""")
def a16_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = quantify.cross_tab(_matrix(_quant(spark, sf_dir)), "peptide", [F.col("condition"), F.col("batch")], ["A/F", "N/O", "R/F"])
    return cells.select("peptide", *[F.round(F.col(f"`{p}`"), 4).alias(p.replace("/", "_").lower()) for p in ("A/F", "N/O", "R/F")])


@query("SELECT DISTINCT peptide FROM m SEMI JOIN uniq USING (peptide)")
def a17_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quant(spark, sf_dir)
    return quantify.visible(_matrix(rows), _unique(rows), "peptide")


@query("""SELECT level, path, filename AS x, CAST(count(*) AS BIGINT) AS n, round(sum(quantity), 2) AS total FROM (SELECT 0 AS level, '' AS path, * FROM m UNION ALL SELECT 1, condition, * FROM m UNION ALL SELECT 2, condition || '/' || batch, * FROM m) GROUP BY 1, 2, 3""")
def a18_facet_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantify.facets(_matrix(_quant(spark, sf_dir)), [F.col("condition"), F.col("batch")], F.col("filename"), F.col("quantity"))
    return found.withColumn("total", F.round("total", 2))


_DESIGN = QUANT + ", design AS (SELECT DISTINCT filename, condition, batch FROM quant)\n"


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quant(spark, sf_dir).select("filename", "condition", "batch").distinct()


@query("""SELECT 'group' AS kind, condition || batch AS key, string_agg(filename, ';' ORDER BY filename) AS value FROM design GROUP BY 2 UNION ALL SELECT 'value', condition, min(filename) FROM design GROUP BY 2
  UNION ALL SELECT 'file', filename, '' FROM design WHERE condition = 'N' AND batch = 'O'""", _DESIGN)
def a19_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _design(spark, sf_dir)
    groups = quantify.design_groups(d, "condition", "batch").select(F.lit("group").alias("kind"), F.concat("condition", "batch").alias("key"), F.array_join("filenames", ";").alias("value"))
    values = quantify.design_values(d, "condition", F.col("filename")).select(F.lit("value").alias("kind"), F.col("value").alias("key"), F.col("place").alias("value"))
    files = quantify.design_files(d, condition="N", batch="O").select(F.lit("file").alias("kind"), F.col("filename").alias("key"), F.lit("").alias("value"))
    return groups.unionByName(values).unionByName(files)


_POINTS = "WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS rt, value AS intensity, CAST(event_id % 1000 + 0.5 AS DOUBLE) AS mz FROM events)\n"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return table(spark, sf_dir, "events").select("user_id", hour.alias("rt"), F.col("value").alias("intensity"), (F.col("event_id") % 1000 + 0.5).alias("mz"))


@query("""SELECT user_id, round(coalesce(sum((rt - t0) * (y + y0) / 2), 0), 2) AS auc FROM (SELECT *, lag(rt) OVER w AS t0, lag(y) OVER w AS y0 FROM (SELECT user_id, rt, sum(intensity) AS y FROM e GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY user_id ORDER BY rt)) GROUP BY 1""", _POINTS)
def a31_summed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.summed_trace_area(_points(spark, sf_dir), ["user_id"]).withColumn("auc", F.round("auc", 2))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n_points, round(sum(mz * intensity) / sum(intensity), 4) AS mz_mean, min(mz) AS mz_low, max(mz) AS mz_high, round(sum(intensity), 3) AS intensity FROM e GROUP BY 1", _POINTS)
def a30_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantify.region_stats(_points(spark, sf_dir), ["user_id"])
    return found.withColumns({"mz_mean": F.round("mz_mean", 4), "intensity": F.round("intensity", 3)})


#: Orders as PSMs: the customer's segment is the file, a q-value is missing where the price is low.
_PSM = """
WITH psm AS (SELECT c_mktsegment AS filename, CAST(o_orderkey AS VARCHAR) AS scan, 'C' || c_custkey AS peptide_plain, CASE WHEN o_totalprice < 50000 THEN NULL ELSE CAST(o_totalprice / 10000000 AS VARCHAR) END AS rescored_q
  FROM orders JOIN customer ON c_custkey = o_custkey)
"""


def _psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = F.when(F.col("o_totalprice") >= 50000, (F.col("o_totalprice") / 10000000).cast("string"))
    return j.select(F.col("c_mktsegment").alias("filename"), F.col("o_orderkey").cast("string").alias("scan"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("peptide_plain"), q.alias("rescored_q"))


@query("SELECT DISTINCT filename, scan FROM psm WHERE coalesce(CAST(rescored_q AS DOUBLE) <= 0.02, true)", _PSM)
def a32_identified_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.identified_scans(_psm(spark, sf_dir), most=0.02)


@query("SELECT filename, peptide_plain, round(min(CAST(rescored_q AS DOUBLE)), 8) AS q FROM psm GROUP BY 1, 2 UNION ALL SELECT 'any', peptide_plain, round(min(CAST(rescored_q AS DOUBLE)), 8) FROM psm GROUP BY 2", _PSM)
def a11_peptide_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _psm(spark, sf_dir)
    both = identify.peptide_q(rows).unionByName(identify.peptide_q(rows, by_file=False).withColumn("filename", F.lit("any")))
    return both.withColumn("q", F.round("q", 8))


#: Documents of benchmark items' length as proteins: peptides that several share are identified, with the number of their holders as q.
_PROTEINS = """
WITH prot AS (SELECT 'D' || item_id AS protein_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark),
sites AS (SELECT protein_id, sequence, i FROM (SELECT *, unnest(range(1, length(sequence))) AS i FROM prot) WHERE substr(sequence, i, 1) IN ('K', 'R') AND substr(sequence, i + 1, 1) <> 'P' UNION SELECT protein_id, sequence, 0 FROM prot UNION SELECT protein_id, sequence, length(sequence) FROM prot),
o AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY i) AS n FROM sites),
pep AS (SELECT DISTINCT a.protein_id, substr(a.sequence, a.i + 1, b.i - a.i) AS peptide FROM o a JOIN o b ON a.protein_id = b.protein_id AND b.n - a.n BETWEEN 1 AND 3 WHERE b.i - a.i BETWEEN 3 AND 12),
found AS (SELECT peptide, CASE WHEN length(peptide) = 5 THEN NULL ELSE length(peptide) / 1000.0 END AS q FROM (SELECT DISTINCT peptide FROM pep) WHERE length(peptide) BETWEEN 4 AND 8),
spans AS (SELECT protein_id, peptide, q, i - 1 AS start, i - 1 + length(peptide) AS stop FROM (SELECT protein_id, peptide, q, sequence, unnest(range(1, length(sequence) - length(peptide) + 2)) AS i FROM pep JOIN found USING (peptide) JOIN prot USING (protein_id)) WHERE substr(sequence, i, length(peptide)) = peptide),
res AS (SELECT protein_id, residue, min(q) AS q FROM (SELECT protein_id, q, unnest(range(start, stop)) AS residue FROM spans) GROUP BY 1, 2)
"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from spectraloom.functions import chemistry as C

    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    prot = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("D"), F.col("item_id").cast("string")).alias("protein_id"), letters.alias("sequence"))
    n = F.length("peptide")
    found = C.digest_rows(prot, "protein_id", "sequence", least=3, most=12).select(F.col("peptide").alias("peptide_plain"), F.when(n != 5, n / 1000.0).alias("q")).where(n.between(4, 8)).distinct()
    return prot, identify.spans(prot, found, 3, 12)


@query("SELECT protein_id, peptide, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, q FROM spans", _PROTEINS)
def i14_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[1].withColumnRenamed("end", "stop")


@query("SELECT protein_id, CAST(residue AS INTEGER) AS residue, q FROM res", _PROTEINS)
def i14_residue_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.residue_q(_placed(spark, sf_dir)[1])


@query("SELECT protein_id, CAST(length(sequence) AS INTEGER) AS length, CAST(count(residue) AS BIGINT) AS covered, round(100.0 * count(residue) / length(sequence), 4) AS percent FROM prot LEFT JOIN res USING (protein_id) GROUP BY 1, sequence", _PROTEINS)
def i14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prot, placed = _placed(spark, sf_dir)
    return identify.coverage(prot, placed).withColumn("percent", F.round("percent", 4))


@query("""SELECT protein_id, round(percent, 4) AS metric, CAST(row_number() OVER (ORDER BY percent DESC, protein_id) AS INTEGER) AS place FROM (SELECT protein_id, 100.0 * count(residue) / length(sequence) AS percent, min(res.q) AS protein_q FROM prot LEFT JOIN res USING (protein_id) GROUP BY 1, sequence)
  WHERE coalesce(protein_q <= 0.004, true)""", _PROTEINS)
def a33_protein_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    prot, placed = _placed(spark, sf_dir)
    best = identify.residue_q(placed).groupBy("protein_id").agg(F.min("q").alias("protein_q"))
    listed = identify.protein_list(identify.coverage(prot, placed).join(best, "protein_id", "left"), 0.004)
    return listed.select("protein_id", F.round("metric", 4).alias("metric"), F.row_number().over(W.orderBy(F.desc("metric"), "protein_id")).alias("place"))
