"""The jobs: growing input, runs that were cut off, repeated runs, and the registered queries against DuckDB."""

import json
import logging
import os
from pathlib import Path

import duckdb
import pytest

from jobs import common, peptide_index, registered, search_tables

FOLDER = "/root/testdata/sf0.001"


def digests(rows):
    """(id, peptide) -> [places, first start], by walking each sequence."""
    out = {}
    for i, text in rows:
        q = "".join(c for c in text or "" if c.isascii() and c.isalpha()).upper()
        cuts = [0, *[k for k in range(1, len(q)) if q[k - 1] in "KR" and q[k] != "P"], len(q)] if q else []
        for a, start in enumerate(cuts):
            for end in cuts[a + 1 : a + 4]:
                if 7 <= end - start <= 50:
                    n, first = out.get((i, q[start:end]), (0, start))
                    out[i, q[start:end]] = (n + 1, min(first, start))
    return out


def entries(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, extra string").coalesce(1).write.mode(mode).parquet(str(path))


def held(index):
    return {(r.id, r.peptide): (r.n_places, r.first_start) for r in index.collect()}


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    one = [(1, "aakbbbbbbkccccccccrpdddk eee", "x"), (2, None, "x"), (3, "", None), (None, "KKKKKKKKKKPPPPPPPPPP", "x"), (4, "Peptide " * 40, "x"), (4, "Peptide " * 2, "x")]
    two = [(5, "mnopqrstuvkabcdefghk", "y"), (1, "zzzzzzzzzzzk", "y")]
    conf, places = common.config(peptide_index.NAME), [str(tmp_path / n) for n in ("in", "out", "state")]
    entries(spark, places[0], one)
    want = digests([r[:2] for r in one])
    assert held(peptide_index.run(spark, *places, conf)) == want
    before = sorted(os.listdir(places[1]))
    assert held(peptide_index.run(spark, *places, conf)) == want and sorted(os.listdir(places[1])) == before
    assert "read 0 entries that were new" in caplog.text
    entries(spark, places[0], two)
    caplog.clear()
    index = peptide_index.run(spark, *places, conf)
    assert "read 2 entries that were new" in caplog.text
    assert {r.batch for r in index.collect()} == {0, 1}
    want |= digests([r[:2] for r in two])
    assert held(index) == want


def test_digest_leaves_an_entry_in_lists(spark):
    """A row for each length of an entry; ids that come again, null too, are summed."""
    rows = [(1, "MAGICKPEPTIDERAAAAAAAKAAAAAAAK" * 3), (2, "CCCCCCCKDDDDDDDR"), (None, "EEEEEEEKEEEEEEEK"), (2, "ACCCCCCKCCCCCCCK"), (None, "EEEEEEEK"), (3, None), (4, "")]
    found = peptide_index.digest(spark.createDataFrame(rows, "doc_id long, text string"), common.config(peptide_index.NAME)).collect()
    assert sum(len(r.found) for r in found) == len(digests(rows))
    assert {(r.id, x.peptide): (x.n_places, x.first_start) for r in found for x in r.found} == digests(rows)
    own = [r.length for r in found if r.id == 1]
    assert len(own) == len(set(own)) and all(len(x.peptide) == r.length for r in found for x in r.found)


def test_index_repeats_a_batch_that_was_cut_off(spark, tmp_path):
    conf, places = common.config(peptide_index.NAME), [str(tmp_path / n) for n in ("in", "out", "state")]
    entries(spark, places[0], [(1, "aaaaaaakbbbbbbbbk", "x")])
    want = held(peptide_index.run(spark, *places, conf))
    # As if the driver had gone before the batch was committed, with a file too many in its folder.
    for name in (tmp_path / "state/commits").iterdir():
        name.unlink()
    spark.createDataFrame([(9, "STRAY", 1, 0)], "id long, peptide string, n_places long, first_start long").write.parquet(f"{places[1]}/batch=0/length=5")
    assert held(peptide_index.run(spark, *places, conf)) == want


def test_index_of_nothing(spark, tmp_path):
    entries(spark, tmp_path / "in", [])
    index = peptide_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), common.config(peptide_index.NAME))
    assert index.count() == 0


def tables(made):
    return {name: sorted(map(str, rows.collect())) for name, rows in made.items()}


def test_search_tables_are_replaced(spark, tmp_path):
    conf = common.config(search_tables.NAME)
    settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
    first = tables(search_tables.run(spark, FOLDER, str(tmp_path), conf))
    runs = {p.name for p in (tmp_path / "psms").iterdir() if p.is_dir()}
    assert all(r.startswith("run_dir=") for r in runs) and "run_dir=run_F_NaCl_1" in runs
    # A run that stopped half way leaves old and new tables; the next one replaces them all.
    search_tables.run(spark, FOLDER, str(tmp_path), conf | {"q_max": 3})
    assert tables(search_tables.run(spark, FOLDER, str(tmp_path), conf)) == first
    listed = [json.loads(line) for f in Path(tmp_path / "files_json").glob("*.json") for line in f.read_text().splitlines()]
    assert sum(f["n_psms"] for f in listed) == sum(r.filename != "" for r in spark.read.parquet(f"{tmp_path}/psms").collect())
    assert settings == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"))


def test_search_tables_of_text_files(spark, tmp_path):
    """Tab-separated results, as a search writes them: blanks, decoys, a repeated id, a PSM that the search does not have."""
    files = {
        "psms.tsv": "PSMId\tfilename\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\na\tr1.mzML\t5\t0.001\t0.1\tK.PEPTIDEK.R\tP1;P2\nb\t\t4\t0.01\t0.1\tPEP[+15.99]K\tP2\nc\tr1.mzML\t4\t\t0\tX\tP1\nd\tr1.mzML\t4\t0\t0\tX\tP1;decoy_P9\ne\tr9.mzML\t3\t0\t0\tONLY\tP3\n",
        "search.tsv": "n\tpsm_id\tfilename\tscannr\tproteins\tcharge\n1\ta\tr1.mzML\tscan=7\tP1\t2\n2\ta\tr1.mzML\tscan=12\tP1\t3\n3\tb\tr2.mzML\tnative\tP2\t2\n",
        "peptides.tsv": "PSMId\tfilename\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\na\tr1.mzML\t5\t0.001\t0\tK.PEPTIDEK.R\tP1\nz\tr1.mzML\t1\t0.02\t0\tLATE\tP1\n",
        "proteins.tsv": "ProteinId\tProteinGroupId\tq-value\tposterior_error_prob\tpeptideIds\nP1,P2\tg1\t0.001\t0\tPEPTIDEK;PEPK\ndecoy_P3\tg2\t0\t0\tX\n",
        "lfq.tsv": "peptide\tcharge\tproteins\tq_value\tscore\tspectral_angle\tr1.mzML\tr2.mzML\nPEPTIDEK\t2\tP1\t0.001\t9\t0.9\t100\t0\nGONE\t2\tP1\t0.5\t9\t0.9\t100\t1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    names = dict(zip(("rescored_psms", "search", "rescored_peptides", "rescored_proteins", "quantities"), files))
    read = {"format": "csv", "options": {"sep": "\t", "header": True}}
    conf = {"q_max": 0.01, "keep_zero_quantities": False, "tables": {t: read | {"path": f, "columns": {c: f"coalesce(`{c}`, '')" for c in files[f].split("\n")[0].split("\t") if c != "n"}} for t, f in names.items()}}
    conf["tables"]["search"]["columns"]["_order"] = "cast(n as int)"
    made = search_tables.run(spark, str(tmp_path), str(tmp_path / "out"), conf)
    psms = {r.psm_id: r for r in made["psms"].collect()}
    assert sorted(psms) == ["a", "b", "e"] and psms["a"].scan == "12" and psms["a"].charge == "3" and psms["b"].filename == "r2.mzML" and psms["b"].scan_key == "r2.mzML:scan=native"
    assert psms["a"].percolator_q == "0.001" and psms["e"].scan == "" and psms["e"].run_dir == "r9"
    (pep,) = made["peptides"].collect()
    assert (pep.peptide, pep.n_psms, pep.scan_keys, pep.has_lfq) == ("PEPTIDEK", 1, "r1.mzML:scan=12", "1")
    (prot,) = made["proteins"].collect()
    assert (prot.protein_id, prot.n_linked_psms, prot.n_files, prot.n_percolator_peptides) == ("P1,P2", 2, 2, 2)
    of_file = {(r.filename, r.peptide): r for r in made["file_peptides"].collect()}
    assert set(of_file) == {("r1.mzML", "PEPTIDEK"), ("r2.mzML", "PEP[+15.99]K"), ("r9.mzML", "ONLY")} and of_file["r1.mzML", "PEPTIDEK"].quantities == "100"
    counts = {r.filename: (r.n_psms, r.n_scans, r.n_quant_rows) for r in made["files"].collect()}
    assert counts == {"r1.mzML": (1, 1, 1), "r2.mzML": (1, 1, 0), "r9.mzML": (1, 0, 0)}


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_registered(spark, name):
    con = duckdb.connect()
    for t in "lineitem orders part supplier documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = registered.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registered.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want) and want


def test_peptides_stay_where_they_are_made(spark, tmp_path, monkeypatch):
    """Peptides go to their files without an exchange; a task more for each so many letters."""
    import builtins

    rows = [(n, "".join("ACDEFGHILK"[(n * 7 + i * i) % 10] for i in range(400))) for n in range(40)]
    kind, conf = "doc_id long, text string", common.config(peptide_index.NAME)
    spark.createDataFrame([(*r, "x") for r in rows], kind + ", lang string").write.parquet(str(tmp_path / "in"))
    wrote, frame = [], type(spark.range(0))
    before = frame.write
    monkeypatch.setattr(frame, "write", builtins.property(lambda self: wrote.append(self._jdf.queryExecution().optimizedPlan().toString()) or before.fget(self)))
    monkeypatch.setattr(peptide_index, "LETTERS", 4000)
    got = held(peptide_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), conf))
    assert got == digests(rows)
    assert len(wrote) == 1 and "RebalancePartitions" not in wrote[0]
    assert len(list((tmp_path / "out/batch=0/length=10").glob("*.parquet"))) > 1
