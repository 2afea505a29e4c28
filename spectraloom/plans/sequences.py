"""Motifs, digestion and masses on stand-in sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as C
from spectraloom.operators import graph, motifs
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as sequences."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("protein_id"), F.col("p_partkey").cast("string").alias("accession"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("sequence"))


def _motif_sql(k: int) -> str:
    inner = f"unnest(range(2, {k}))"
    return f"""
WITH s AS (SELECT p_partkey AS pid, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS q FROM part),
w AS (SELECT DISTINCT pid, substr(q, i, {k}) AS win FROM (SELECT pid, q, unnest(range(1, greatest(length(q) - {k} + 2, 1))) AS i FROM s) WHERE length(substr(q, i, {k})) = {k}),
v AS (SELECT pid, win, substr(win, 1, 1) AS f, substr(win, {k}, 1) AS l FROM w WHERE NOT regexp_matches(win, '[BJOXZU]')),
n AS (SELECT f, l, count(DISTINCT pid) AS parent FROM v GROUP BY 1, 2),
c AS (SELECT DISTINCT pid, f, l, p, substr(win, p, 1) AS aa FROM (SELECT *, {inner} AS p FROM v)),
ch AS (SELECT c.f, c.l, p, aa, count(*) AS size, any_value(parent) AS parent FROM c JOIN n USING (f, l) GROUP BY 1, 2, 3, 4
  HAVING count(*) >= greatest(1, ceil(any_value(parent) * CAST(0.35 AS DOUBLE)))),
cov AS (SELECT f, l, p, count(DISTINCT pid) AS covered FROM c SEMI JOIN ch USING (f, l, p, aa) GROUP BY 1, 2, 3),
sc AS (SELECT f, l, p, covered, count(*) AS total, count(*) FILTER (WHERE size < parent) AS fresh FROM ch JOIN cov USING (f, l, p)
  GROUP BY 1, 2, 3, 4 HAVING covered >= ceil(any_value(parent) * CAST(0.65 AS DOUBLE))),
best AS (SELECT f, l, p FROM (SELECT *, rank() OVER (PARTITION BY f, l ORDER BY covered DESC, fresh DESC, total DESC) AS r FROM sc) WHERE r = 1)
SELECT f || repeat('.', p - 2) || aa || repeat('.', {k} - 1 - p) || l AS motif_text, CAST(size AS BIGINT) AS protein_count FROM ch SEMI JOIN best USING (f, l, p)
UNION ALL SELECT f || repeat('.', {k} - 2) || l, CAST(parent AS BIGINT) FROM n ANTI JOIN best USING (f, l)"""


@query(_motif_sql(5))
def m05_motifs_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = motifs.representatives(_proteins(spark, sf_dir), None)
    return motifs.counts(motifs.mine(motifs.windows(groups, 5, 5), 5))


@query(_motif_sql(6))
def m05_motifs_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = motifs.representatives(_proteins(spark, sf_dir), None)
    return motifs.counts(motifs.mine(motifs.windows(groups, 6, 6), 6))


@query(None)
def m06_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = motifs.representatives(_proteins(spark, sf_dir), None)
    return motifs.postings(motifs.mine_all(motifs.windows(groups)), members)


@query(f"""
WITH m AS ({_motif_sql(5)}), r AS (SELECT motif_text, length(motif_text) - 2 AS slots, length(replace(substr(motif_text, 2, length(motif_text) - 2), '.', '')) AS n FROM m),
c AS (SELECT *, unnest(range(0, slots)) AS i FROM r WHERE n > 0)
SELECT CAST(least(9, floor(i / slots * 10)) AS INTEGER) AS bin, round(sum(CAST(substr(motif_text, i + 2, 1) <> '.' AS DOUBLE)), 4) AS observed, round(sum(n / slots), 4) AS expected
FROM c GROUP BY 1""")
def a34_positional_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = motifs.positional_bias(m05_motifs_5(spark, sf_dir))
    return b.select("bin", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"))


@query("""
WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents),
x AS (SELECT doc_id, q, i AS cut FROM (SELECT doc_id, q, unnest(range(1, length(q))) AS i FROM s) WHERE substr(q, i, 1) IN ('K', 'R') AND substr(q, i + 1, 1) <> 'P'
  UNION ALL SELECT doc_id, q, 0 FROM s WHERE q <> '' UNION ALL SELECT doc_id, q, length(q) FROM s WHERE q <> ''),
o AS (SELECT doc_id, cut, row_number() OVER (PARTITION BY doc_id ORDER BY cut) AS n FROM x)
SELECT a.doc_id, CAST(count(*) AS BIGINT) AS spans, CAST(sum(b.cut - a.cut) AS BIGINT) AS residues, CAST(count(DISTINCT substr(s.q, a.cut + 1, b.cut - a.cut)) AS BIGINT) AS peptides
FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.n - a.n BETWEEN 1 AND 3 JOIN s ON s.doc_id = a.doc_id WHERE b.cut - a.cut BETWEEN 7 AND 50 GROUP BY 1""")
def i12_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    residues = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    told = lambda xs: F.struct(F.size(xs).cast("long").alias("spans"), residues(xs).alias("residues"), F.size(F.array_distinct(xs)).cast("long").alias("peptides"))
    found = F.filter(F.transform(F.array(C.digest_peptides(q)), told), lambda x: x["spans"] > 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found))


@query(None)
def d22_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers (ids below 0) that any line item links, over whole tables."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return graph.components(l.select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b")).distinct(), "a", "b")


@query(None)
def i03_isotope_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotope peaks of the averagine composition of each part's price as a mass."""
    p = table(spark, sf_dir, "part").select("p_partkey", C.averagine_composition(F.col("p_retailprice")).alias("atoms"))
    each = p.select("atoms").distinct().withColumn("peaks", C.isotopes("atoms"))
    return p.join(each, "atoms").select("p_partkey", F.posexplode("peaks").alias("isotope", "peak")).select("p_partkey", "isotope", "peak.mass", "peak.abundance")
