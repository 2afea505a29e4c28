"""Fragment ions, their peaks and their coverage on stand-in spectra, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as C
from spectraloom.functions import isotopologues
from spectraloom.functions.scalars import PROTON
from spectraloom.operators import fragments, graph, rank_choice
from spectraloom.sources.tables import table

QUERIES, ORACLES = {}, {}
PPM = 5000.0
_LETTERS = "[^ACDEFGHIKLMNPQRSTVWY]"

#: Part names are peptides, the sizes of parts are spectra, and retail prices their peaks.
FRAGMENTS = f"""
WITH res(r, m) AS (VALUES {", ".join(f"('{r}', CAST({m!r} AS DOUBLE))" for r, m in C.RESIDUE_MASS.items() if r in "ACDEFGHIKLMNPQRSTVWY")}),
cand AS (SELECT p_partkey AS id, p_size AS spectrum, regexp_replace(upper(p_name), '{_LETTERS}', '', 'g') AS q FROM part),
l AS (SELECT id, spectrum, q, i, sum(m) OVER (PARTITION BY id ORDER BY i) AS pre, sum(m) OVER (PARTITION BY id) AS tot FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM cand) JOIN res ON r = substr(q, i, 1)),
ions AS (SELECT id, spectrum, q, 'b' AS ion, CAST(i AS INTEGER) AS place, z AS charge, (pre + z * {PROTON!r}) / z AS mz FROM l, (SELECT unnest([1, 2]) AS z) WHERE i < length(q)
  UNION ALL SELECT id, spectrum, q, 'y', CAST(length(q) - i AS INTEGER), z, (tot - pre + CAST({C.WATER_MASS!r} AS DOUBLE) + z * {PROTON!r}) / z FROM l, (SELECT unnest([1, 2]) AS z) WHERE i < length(q)),
peaks AS (SELECT DISTINCT p_size AS spectrum, p_retailprice AS peak_mz, CAST(1 + floor(p_retailprice) % 97 AS DOUBLE) AS intensity FROM part)
"""


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("spectrum"), F.regexp_replace(F.upper("p_name"), _LETTERS, "").alias("sequence"))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("spectrum"), price.alias("peak_mz"), (1 + F.floor(price) % 97).cast("double").alias("intensity")).distinct()


def _ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ions of each spectrum's sequences, each sequence once."""
    return fragments.ion_rows(_peptides(spark, sf_dir).select("spectrum", "sequence").distinct(), "spectrum")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = FRAGMENTS + sql
        return f

    return add


@query("SELECT id AS candidate_id, ion, place, charge, round(mz, 4) AS mz FROM ions")
def i06_fragment_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments.ion_rows(_peptides(spark, sf_dir), "candidate_id")
    return rows.withColumn("mz", F.round("mz", 4))


_ANNOTATED = f""", near AS (SELECT spectrum, ion, place, charge, mz, peak_mz, intensity, id, rank() OVER (PARTITION BY spectrum, id, ion, place, charge ORDER BY abs(mz - peak_mz)) AS n FROM ions JOIN peaks USING (spectrum) WHERE abs(mz - peak_mz) < mz / 1e6 * {PPM})"""


@query(f"""{_ANNOTATED}
SELECT spectrum, peak_mz, ion, place, charge, round(min(mz), 3) AS theo_mz, round((peak_mz - min(mz)) / min(mz) * 1e6, 2) AS error FROM near WHERE n = 1 GROUP BY spectrum, peak_mz, intensity, ion, place, charge, round(mz, 4)""")
def i10_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = _ions(spark, sf_dir)
    rows = fragments.annotate(ions, _peaks(spark, sf_dir), PPM)
    return rows.select("spectrum", "peak_mz", *fragments.LABEL, F.round("theo_mz", 3).alias("theo_mz"), F.round("error", 2).alias("error"))


@query(f"SELECT spectrum, peak_mz, intensity FROM peaks WHERE NOT EXISTS (SELECT 1 FROM ions WHERE ions.spectrum = peaks.spectrum AND abs(mz - peak_mz) < mz / 1e6 * {PPM})")
def i10_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks without an ion: here every ion within the tolerance has its nearest peak, but only peaks that are nearest to none and within none's reach count."""
    ions, peaks = _ions(spark, sf_dir), _peaks(spark, sf_dir)
    from spectraloom.operators import joins

    within = joins.ppm_join(ions.select("spectrum", "mz").distinct(), peaks, "mz", "peak_mz", PPM, ["spectrum"], strict=True)
    return fragments.unmatched(peaks, within)


@query(f""", g AS (SELECT spectrum, ion, place, charge, round(mz, 3) AS m, min(mz) AS theo_mz FROM ions GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT g.*, max(intensity) AS intensity FROM g JOIN peaks USING (spectrum) WHERE abs(theo_mz - peak_mz) <= theo_mz / 1e6 * {PPM} GROUP BY ALL)
SELECT g.spectrum, g.ion, g.place, g.charge, round(g.theo_mz, 3) AS theo_mz, b.intensity IS NOT NULL AS matched, coalesce(b.intensity, 0) AS intensity FROM g LEFT JOIN b USING (spectrum, ion, place, charge, m)""")
def j25_best_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = _ions(spark, sf_dir)
    return fragments.best_peaks(ions, _peaks(spark, sf_dir), PPM).select("spectrum", *fragments.LABEL, F.round("theo_mz", 3).alias("theo_mz"), "matched", "intensity")


@query(f""", lab AS (SELECT DISTINCT id, q, ion, place FROM ions JOIN peaks USING (spectrum) WHERE abs(mz - peak_mz) <= mz / 1e6 * {PPM}),
cut AS (SELECT DISTINCT id, q, CASE ion WHEN 'b' THEN place ELSE length(q) - place END AS c FROM lab),
edge AS (SELECT id, q, c FROM cut UNION SELECT id, q, 0 FROM cut),
seg AS (SELECT id, q, c AS a, coalesce(lead(c) OVER (PARTITION BY id ORDER BY c), length(q)) AS b FROM edge),
cov AS (SELECT seg.id, seg.q, a, b, (SELECT count(*) FROM lab WHERE lab.id = seg.id AND ((ion = 'b' AND place > a) OR (ion = 'y' AND length(lab.q) - place <= a))) AS covers FROM seg),
agg AS (SELECT id, any_value(length(q)) AS n, count(*) AS segs, sum(ln(1.0 / (b - a) / length(q))) AS iso, sum((b - a) * covers) AS counts FROM cov WHERE covers > 0 GROUP BY 1),
ends AS (SELECT id, count(*) AS n_ions, coalesce(max(place) FILTER (WHERE ion = 'b'), 0) AS f, coalesce(max(place) FILTER (WHERE ion = 'y'), 0) AS k FROM lab GROUP BY 1)
SELECT cand.id AS candidate_id, CAST(coalesce(n_ions, 0) AS INTEGER) AS n_ions, CAST(coalesce(n - greatest(0, n - k - f), 0) AS INTEGER) AS covered, CAST(coalesce(segs, 0) AS INTEGER) AS n_segments,
  round(coalesce(ln(1.0 / segs) + iso + ln(1.0 / (f + k)), 0), 4) AS log_score, CAST(coalesce(n_ions + counts, 0) AS INTEGER) AS match_counts FROM cand LEFT JOIN agg USING (id) LEFT JOIN ends USING (id)""")
def i11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments.report(_peptides(spark, sf_dir), _peaks(spark, sf_dir), PPM)
    return rows.select("candidate_id", "n_ions", "covered", "n_segments", F.round(F.when(F.col("score") > 0, F.ln("score")).otherwise(0.0), 4).alias("log_score"), "match_counts")


@query(f"""SELECT formula, CAST(count(*) AS BIGINT) AS n, min(q) AS first FROM (SELECT DISTINCT q, 'C' || c || 'H' || (h + 2) || 'N' || n || 'O' || (o + 1) || CASE WHEN s > 0 THEN 'S' || s ELSE '' END AS formula FROM
  (SELECT q, id, sum(c) AS c, sum(h) AS h, sum(n) AS n, sum(o) AS o, sum(s) AS s FROM (SELECT id, q, substr(q, CAST(i AS INTEGER), 1) AS r FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM cand)) JOIN
  (VALUES {", ".join(f"('{r}', {x[0]}, {x[1]}, {x[2]}, {x[3]}, {x[4]})" for r, x in C.RESIDUES.items() if r in "ACDEFGHIKLMNPQRSTVWY")}) t(r, c, h, n, o, s) USING (r) GROUP BY 1, 2)) GROUP BY 1""")
def i17_by_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_formula(_peptides(spark, sf_dir).where("sequence <> ''"), "sequence").select("formula", "n", F.get("sequences", F.lit(0)).alias("first"))


@query("""SELECT id AS candidate_id, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(len) AS BIGINT) AS residues FROM (
  WITH d AS (SELECT id, q FROM cand WHERE q <> ''), s AS (SELECT id, q, i FROM (SELECT *, unnest(range(1, length(q))) AS i FROM d) WHERE substr(q, CAST(i AS INTEGER), 1) = 'L' AND substr(q, CAST(i AS INTEGER) - 1, 2) <> 'AL' OR substr(q, CAST(i AS INTEGER), 1) = 'E' UNION SELECT id, q, 0 FROM d UNION SELECT id, q, length(q) FROM d),
  o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM s),
  p AS (SELECT a.id, a.i AS start, b.i AS stop, a.q FROM o a JOIN o b ON a.id = b.id AND b.k - a.k BETWEEN 1 AND 2)
  SELECT id, 1 AS n, stop - start AS len FROM p WHERE stop - start BETWEEN 2 AND 20 UNION ALL SELECT id, 1, stop - start - 1 FROM p WHERE start = 0 AND q LIKE 'M%' AND stop - start - 1 BETWEEN 2 AND 20) GROUP BY 1""")
def i15_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut behind E, and behind L unless AL ends there; the first M may be missing."""
    cuts = C.cutting({"E": (), "L": ("AL",)})
    rows = C.digest_rows(_peptides(spark, sf_dir), "candidate_id", "sequence", 1, 2, 20, cuts, bare=True)
    return rows.groupBy("candidate_id").agg(F.count("*").alias("spans"), F.sum(F.length("peptide")).alias("residues"))


@query(None)
def i09_fragment_isotopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the first isotopes of each part's peptide as a doubly charged precursor, from 0.1 m/z below it to 1.1 above."""
    p = _peptides(spark, sf_dir).where(F.length("sequence") > 1).withColumn("m", C.peptide_mass(F.col("sequence")) / 2 + PROTON)
    asked = p.select(F.col("candidate_id").alias("precursor_id"), "sequence", F.lit(2).alias("charge"), (F.col("m") - 0.1).alias("low"), (F.col("m") + 1.1).alias("high"))
    return isotopologues.fragment_isotopes(asked)


@query(None)
def i18_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotopologues of every formula of the parts' peptides, down to a hundredth of the likeliest."""
    return isotopologues.extend_library(_peptides(spark, sf_dir).where("sequence <> ''").select("sequence"), None)


@query(f"""{_ANNOTATED} SELECT spectrum, peak_mz, intensity FROM peaks ANTI JOIN (SELECT spectrum, peak_mz FROM near WHERE n = 1) USING (spectrum, peak_mz)""")
def i10_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that the annotation gives to no ion."""
    ions, peaks = _ions(spark, sf_dir), _peaks(spark, sf_dir)
    return fragments.unmatched(peaks, fragments.annotate(ions, peaks, PPM))


def _fragment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matched peaks: a part is a scan, a return flag a peptide, a supplier's parity an ion, a line number an isotope rank."""
    rank, item = F.col("l_linenumber") - 1, table(spark, sf_dir, "lineitem")
    sequence = F.when(F.col("l_returnflag") == "A", "PEPTIDEK").when(F.col("l_returnflag") == "N", "SAMPLER").otherwise("ELVISK")
    expected = F.lit(300.0) + rank
    return item.select(
        F.col("l_partkey").alias("scan"), F.lit(0).cast("long").alias("line"), (F.col("l_partkey") % 7).alias("distribution"), (F.col("l_partkey") % 50).alias("analyte"), sequence.alias("sequence"), F.lit(1).alias("charge"),
        F.when(F.col("l_suppkey") % 2 == 0, "b2").otherwise("y3").alias("ion"), rank.alias("rank"), expected.alias("expected_mz"), (expected + F.col("l_discount") / 100 + F.col("l_orderkey") / 1e9).alias("mz"),
        (1 / F.sqrt(rank + 1.0)).alias("abundance"), F.col("l_extendedprice").alias("intensity"), F.col("l_orderkey").alias("place"), F.col("l_quantity").alias("score"),
    )


@query(None)
def i19_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides by the isotope ranks of their ions: the last of three levels of rankings."""
    matches = _fragment_matches(spark, sf_dir)
    chosen = rank_choice.choose(matches, matches.groupBy("scan").agg(F.avg("intensity").alias("average")))
    return rank_choice.rankings(graph.settled(chosen, "chosen"))["peptide"].select("sequence", "analyte", "n_scans", "n_distributions", "n_peaks", F.round("ion_score", 3).alias("ion_score"), F.round("ppm", 3).alias("ppm"), F.round("intensity", 2).alias("intensity"), "place")
