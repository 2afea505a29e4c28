import numpy as np
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as C
from spectraloom.functions import scalars as S
from spectraloom.operators import graph, motifs
from spectraloom.plans import registry


def test_masses_and_compositions(spark):
    row = spark.createDataFrame([("PEPTIDE", "PEZ")], "a string, b string").select(C.peptide_mass(F.col("a")), C.composition(F.col("a")), C.peptide_mass(F.col("b"))).first()
    assert abs(row[0] - 799.35996) < 1e-4 and tuple(row[1]) == (34, 53, 7, 15, 0, 0) and row[2] is None


def test_fragments(spark):
    rows = spark.createDataFrame([("PEK",), ("P",)], "s string").select("s", F.explode(C.fragments(F.col("s"), (1,), "by")).alias("f")).select("f.*").collect()
    got = {f"{r.ion}{r.place}": r.mz for r in rows}
    assert set(got) == {"b1", "b2", "y1", "y2"} and abs(got["y1"] - 147.11280) < 1e-4 and abs(got["b2"] - 227.10263) < 1e-4


def test_digest_and_tiling(spark):
    row = spark.createDataFrame([("AKPRAAAAAAAK",), ("",)], "s string").select(C.cut_sites(F.col("s")), C.digest(F.col("s"), 2, 3, 50), C.tiling(F.col("s"))).collect()
    assert row[0][0] == [0, 4, 12] and [tuple(x) for x in row[0][1]] == [(0, 4, "AKPR"), (0, 12, "AKPRAAAAAAAK"), (4, 12, "AAAAAAAK")]
    assert [tuple(x) for x in row[0][2]] == [(0, 4, False), (4, 12, True)] and row[1][0] == [] and row[1][1] == []


def test_digest_rows_are_the_column(spark):
    df = spark.createDataFrame([(1, "AKPRAAAAAAAKCCRDDK"), (2, ""), (3, None), (4, "KKKRP")], "id int, s string")
    want = {(r.id, *r.x) for r in df.select("id", F.explode(C.digest(F.col("s"), 2, 1, 9)).alias("x")).collect()}
    assert {tuple(r) for r in C.digest_rows(df, "id", "s", 2, 1, 9).collect()} == want and len(want) > 5


def test_coverage_string(spark):
    assert spark.createDataFrame([("ABCDE", [2, 4, 2, 9])], "s string, c array<int>").select(C.coverage_string(F.col("s"), F.col("c"))).first()[0] == "AB|CD|E"


def test_isotope_pattern_against_enumeration():
    mass, share = C.isotope_pattern({"C": 2, "O": 1}, 1e-12)
    want = {}
    for a in C.ISOTOPES["C"]:
        for b in C.ISOTOPES["C"]:
            for o in C.ISOTOPES["O"]:
                m, p = a[0] + b[0] + o[0], a[1] * b[1] * o[1]
                s = want.setdefault(round(m), [0.0, 0.0])
                s[0] += p
                s[1] += p * m
    assert np.allclose(share, [want[k][0] for k in sorted(want)]) and np.allclose(mass, [want[k][1] / want[k][0] for k in sorted(want)])


def test_isotopes_of_columns(spark):
    atoms = spark.createDataFrame([(1000.0,), (1000.0,), (5000.0,)], "m double").select(C.averagine_composition(F.col("m")).alias("atoms"))
    rows = atoms.select(C.isotopes("atoms").alias("p")).collect()
    assert rows[0] == rows[1] and abs(sum(x.abundance for x in rows[2].p) - 1) < 1e-3


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (7, 7), (50, 50)], "a long, b long")
    got = dict(map(tuple, graph.components(e, "a", "b").collect()))
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 50: 50}


def brute(seqs, k, s):
    """Motifs by recursion over explicit window lists."""
    import math

    inner, out = motifs.budget(k, s), set()
    wins = [(g, q[i : i + k]) for g, q in seqs.items() for i in range(len(q) - k + 1) if not set(q[i : i + k]) & set("BJOXZU")]

    def go(entries, fixed, blocked):
        parent = {g for g, _ in entries}
        text = "".join(entries[0][1][i] if i in fixed else "." for i in range(k))
        done = len(fixed) - 2
        options = {}
        for p in range(1, k - 1):
            if p in fixed or p in blocked or done >= inner:
                continue
            kids = {a: [e for e in entries if e[1][p] == a] for a in {e[1][p] for e in entries}}
            kids = {a: e for a, e in kids.items() if len({g for g, _ in e}) >= max(1, math.ceil(len(parent) * (s * ((done + 1) / inner))))}
            covered = {g for e in kids.values() for g, _ in e}
            if kids and len(covered) >= math.ceil(len(parent) * (1 - s)):
                options[p] = ((len(covered), sum({g for g, _ in e} != parent for e in kids.values()), len(kids)), kids)
        if not options:
            out.update((text, g) for g in parent)
            return
        top = max(o[0] for o in options.values())
        tied = sorted(p for p, o in options.items() if o[0] == top)
        for p in tied:
            for e in options[p][1].values():
                go(e, fixed | {p}, blocked | {q for q in tied if q < p})

    for ends in {(w[0], w[-1]) for _, w in wins}:
        go([e for e in wins if (e[1][0], e[1][-1]) == ends], {0, k - 1}, set())
    return out


def test_motifs_against_recursion(spark):
    import random

    rng = random.Random(5)
    seqs = {i: "".join(rng.choice("ACDX") for _ in range(rng.randint(3, 30))) for i in range(12)}
    groups = spark.createDataFrame([(g, q, 1) for g, q in seqs.items()], "gid long, sequence string, n long")
    for k in (5, 7, 8):
        got = {(r.motif_text, r.gid) for r in motifs.mine(motifs.windows(groups, k, k), k).collect()}
        assert got == brute(seqs, k, 0.35)


def test_representatives(spark):
    rows = [(1, "B1", "TrEMBL", "AAA"), (2, "A9", "SwissProt", "AAA"), (3, "A1", "Other", "CCC"), (4, "Z", "Other", "")]
    groups, members = motifs.representatives(spark.createDataFrame(rows, "protein_id long, accession string, source string, sequence string"))
    assert {(r.gid, r.n) for r in groups.collect()} == {(2, 2), (3, 1)} and {tuple(r) for r in members.select("protein_id", "gid").collect()} == {(1, 2), (2, 2), (3, 3)}


def test_join_unique_orders_whole_numbers(spark):
    assert spark.createDataFrame([(["10", "9", "b", "1.5", "", "9"],)], "v array<string>").select(S.join_unique(F.col("v"))).first()[0] == "9;10;1.5;b"


def test_components_of_whole_tables(spark, tmp_path):
    links = [(p, p % 1000 // 10) for p in range(1, 3000, 7)] + [(5000, 2000), (5001, 2000), (5001, 2001)]  # far beyond 59 and 39 ids
    spark.createDataFrame(links * 2, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, s in links:
        a, b = find(p), find(-s)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, registry.QUERIES["d22_components_whole"](spark, str(tmp_path)).collect()))
    assert got == {x: find(x) for x in list(root)} and got[5000] == got[-2001] == -2001


def test_postings_have_motifs_of_all_lengths(spark, tmp_path):
    spark.createDataFrame([(1, "acdefghiklmn"), (2, "acdef")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES["m06_postings"](spark, str(tmp_path)).collect()
    assert {len(r.motif_text) for r in found} == set(range(5, 13)) and {r.protein_id for r in found} == {1, 2}


def test_digest_peptides_are_those_of_the_rows(spark, tmp_path):
    """The array holds what digest_rows gives, and i12_digest takes it without an exchange."""
    texts = ["", "K", "MKRPK", "AAAAAAAKBBBBBBBRPCCCCCCCKDDDDDDDKAAAAAAAK", "AAAAAAAK" * 40, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted((r.doc_id, r.peptide) for r in C.digest_rows(frame, "doc_id", "text").collect())
    got = frame.select("doc_id", F.explode(C.digest_peptides(F.col("text"))).alias("peptide"))
    assert sorted(map(tuple, got.collect())) == rows and rows
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    query = registry.QUERIES["i12_digest"](spark, str(tmp_path))
    assert "Exchange" not in query._jdf.queryExecution().executedPlan().toString()
    want = {i: (len(p), sum(map(len, p)), len(set(p))) for i in range(6) if (p := [x for d, x in rows if d == i])}
    assert {r.doc_id: (r.spans, r.residues, r.peptides) for r in query.collect()} == want
