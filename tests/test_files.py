import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import reorganize as R
from spectraloom.sources import files, spectra


def param(accession, value="", name="x", unit=""):
    return f'<cvParam accession="{accession}" name="{name}" value="{value}" unitName="{unit}"/>'


def array(kind, values, wide, packed):
    raw = struct.pack(f"<{len(values)}{'d' if wide else 'f'}", *values)
    terms = param(kind) + param(spectra.FLOAT64 if wide else "MS:1000521") + (param(spectra.ZLIB) if packed else "")
    return f"<binaryDataArray>{terms}<binary>{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</binary></binaryDataArray>"


def spectrum(i, level, rt, mz, inten, unit="minute", precursor="", kind="MS:1000127"):
    time = f"<scanList><scan>{param(spectra.RT, rt, unit=unit)}</scan></scanList>" if rt is not None else ""
    arrays = array(spectra.MZ_ARRAY, mz, True, True) + array(spectra.INTENSITY_ARRAY, inten, False, False)
    return f'<spectrum id="controller=0 scan={i + 1}" index="{i}">{param(spectra.LEVEL, level)}{param(kind)}{time}{precursor}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


@pytest.fixture(scope="module")
def mzml(spark, tmp_path_factory):
    ion = f"<selectedIonList><selectedIon>{param(spectra.SELECTED, 500.5)}{param(spectra.CHARGE, 2)}</selectedIon></selectedIonList>"
    window = f"<isolationWindow>{param(spectra.TARGET, 500.6)}{param(spectra.LOWER, 1)}{param(spectra.UPPER, 2)}</isolationWindow>"
    rows = [
        spectrum(0, 1, 60.0, [500.0, 501.0], [1.0, 2.0], "second"),
        spectrum(1, 2, 1.1, [100.0], [5.0], precursor=f'<precursorList><precursor spectrumRef="scan=1">{window}{ion}</precursor></precursorList>'),
        spectrum(2, 2, 1.2, [], [], precursor=f"<precursorList><precursor>{ion}</precursor></precursorList>", kind="MS:1000128"),
        spectrum(3, 1, None, [1.0], [1.0]),
        spectrum(4, 1, 2.0, [500.001, 700.0], [4.0, 8.0]),
    ]
    path = tmp_path_factory.mktemp("mzml") / "a.mzML"
    path.write_text(f"<mzML><run><spectrumList>{''.join(rows)}</spectrumList></run></mzML>")
    return spectra.read_mzml(spark, str(path))


def test_mzml(mzml):
    rows = mzml.orderBy("spectrum_index").collect()
    assert [r.ms_level for r in rows] == [1, 2, 2, 1, 1] and rows[0].rt == 1.0 and rows[0].mz == [500.0, 501.0] and rows[0].intensity == [1.0, 2.0]
    assert (rows[1].scan_number, rows[1].precursor_charge) == ("2", 2) and abs(rows[1].isolation_low - 499.6) < 1e-9 and abs(rows[1].isolation_high - 502.6) < 1e-9
    assert rows[2].isolation_low == rows[2].isolation_high == 500.5 and rows[2].mz == []
    assert {(r.ms_level, r["class"]) for r in spectra.level_report(mzml).collect()} == {(1, "centroid"), (2, "mixed")}
    assert {(r.spectrum_index, r.ms1_index) for r in spectra.preceding_ms1(mzml).collect()} == {(1, 0), (2, 0)}


def test_ms1_tables(mzml, spark):
    first = spectra.ms1(mzml, 1.5)
    assert [(r.scan, r.n_points, r.tic) for r in first.orderBy("scan").collect()] == [(0, 1, 2.0), (1, 2, 12.0)]
    x = spectra.chromatograms(spectra.ms1(mzml), [500.0, 600.0]).orderBy("scan", "target").collect()
    assert [(r.scan, r.target, r.intensity) for r in x] == [(0, 500.0, 1.0), (0, 600.0, 0.0), (1, 500.0, 4.0), (1, 600.0, 0.0)]
    pts = spectra.points(spectra.ms1(mzml))
    assert {(r.scan, r.bin, r.intensity) for r in spectra.raster(pts, 500.0, 700.0, 2).collect()} == {(0, 0, 2.0), (1, 0, 4.0), (1, 1, 8.0)}
    assert spectra.profile_raster(spectra.ms1(mzml), 500.0, 501.0, 3).orderBy("scan").first().row == [1.0, 1.5, 2.0]
    box = spark.createDataFrame([(1, 502.0, 503.0, 0.5, 1.1), (2, 600.0, 601.0, 0.0, 9.0)], "box_id int, mz_min double, mz_max double, rt_start double, rt_end double")
    assert [r.box_id for r in spectra.ms2_on(mzml, box.join(mzml.select("file").distinct())).collect()] == [1]


def test_unequal_arrays_fail(spark):
    odd = spark.createDataFrame([("f", "s", 0, 1, 1.0, [1.0], [1.0, 2.0])], "file string, spectrum_id string, spectrum_index long, ms_level int, rt double, mz array<double>, intensity array<double>")
    with pytest.raises(Exception, match="differ in length"):
        spectra.ms1(odd).collect()


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|A_X one\r\nmk\n\nLL\n>tr|Q2|B two > x\nAAA\n>empty\n>plain\nC\n")
    p = files.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert {(r.accession, r.source, r.sequence) for r in p.collect()} == {("P1", "SwissProt", "MKLL"), ("Q2", "TrEMBL", "AAA"), ("plain", "Other", "C")}
    files.write_fasta(files.with_decoys(p), str(tmp_path / "out"), 3)
    again = files.read_fasta(spark, str(tmp_path / "out"))
    assert {(r.header, r.sequence) for r in again.where("header LIKE 'decoy%'").collect()} == {("decoy_sp|P1|A_X one", "LLKM"), ("decoy_tr|Q2|B two > x", "AAA"), ("decoy_plain", "C")}
    assert files.keep_sources(p).count() == 1 and files.keep_sources(p, True, True).count() == 3


def test_pin_design_tsv(spark, tmp_path):
    (tmp_path / "x.pin").write_text("Id\tPeptide\tProteins\n1\tK.PEP.R\tA\tB\n2\tPEK\t\n")
    rows = files.read_pin(spark, str(tmp_path / "x.pin")).orderBy("peptide").collect()
    assert [(r.peptide, r.proteins) for r in rows] == [("K.PEP.R", ["A", "B"]), ("PEK", [])]
    (tmp_path / "d.csv").write_text("filename, condition\nRun_1.centroid.mzML , a\n")
    d = files.read_design(spark, str(tmp_path / "d.csv")).first()
    assert (d.filename, d.condition, d.file_key) == ("Run_1.centroid.mzML", "a", "run_1")
    files.write_tsv(spark.createDataFrame([(1, "x")], "a int, z string"), str(tmp_path / "t"), ["a", "b"])
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "t")).collect()] == [("1", "")]


def test_links(spark):
    html = """<a href="b.raw">x</a><A HREF='a.RAW'><a href="c.txt#p"><a href="b.raw">"""
    assert spark.createDataFrame([(html,)], "h string").select(files.links(F.lower("h"), [".raw"])).first()[0] == ["a.raw", "b.raw"]


def test_reorganised_tables(spark):
    search = spark.createDataFrame([("1", "f1.mzML", "scan=7", "P1", "2", 0), ("1", "f1.mzML", "scan=8", "P1", "3", 1)], "psm_id string, filename string, scannr string, proteins string, charge string, _order int")
    cols = ["PSMId", "filename", "score", "q-value", "posterior_error_prob", "peptide", "proteinIds"]
    psm = spark.createDataFrame(
        [("1", "", "5", "0.001", "0.1", "K.PEP[+1]K.R", "P1;P2"), ("2", "f2.mzML", "4", "0.01", "0.1", "AAK", "P2"), ("3", "f1.mzML", "4", "0.001", "", "AAK", "decoy_P1;P2"), ("4", "f1.mzML", "1", "", "", "A", "P1")], cols
    )
    p = R.psms(psm, search)
    assert {(r.psm_id, r.filename, r.scan, r.charge, r.peptide, r.peptide_plain) for r in p.collect()} == {("1", "f1.mzML", "8", "3", "PEP[+1]K", "PEPK"), ("2", "f2.mzML", "", "", "AAK", "AAK")}
    lfq = spark.createDataFrame([("PEP[+1]K", "2", "P1", "0.001", "1", "0.9", "10.5", "0.0"), ("CCK", "2", "P3", "0.005", "1", "0.9", "", "3")], R.LFQ_FIELDS + ["f1.mzML", "f2.mzML"])
    q = R.quantities(lfq)
    assert {(r.peptide, r.filename, r.quantity) for r in q.collect()} == {("PEP[+1]K", "f1.mzML", "10.5"), ("CCK", "f1.mzML", ""), ("CCK", "f2.mzML", "3")}
    g = R.peptides(psm, p, q)
    assert {(r.peptide, r.n_psms, r.has_lfq) for r in g.collect()} == {("PEP[+1]K", 1, "1"), ("AAK", 1, "0")}
    fp = {(r.filename, r.peptide): r for r in R.file_peptides(p, q, g).collect()}
    assert len(fp) == 4 and fp["f1.mzML", "PEP[+1]K"].best_rescored_q == 0.001 and fp["f2.mzML", "CCK"].n_psms == 0 and fp["f2.mzML", "AAK"].best_rescored_score == 4.0
    prot = spark.createDataFrame([("P1;P2", "1", "0.001", "0.1", "PEPK AAK"), ("decoy_P9", "2", "0.001", "0.1", "")], ["ProteinId", "ProteinGroupId", "q-value", "posterior_error_prob", "peptideIds"])
    gp = R.proteins(prot, p)
    r = gp.first()
    assert gp.count() == 1 and (r.n_linked_psms, r.n_files, r.psm_ids, r.n_rescored_peptides) == (2, 2, "1;2", 2)
    byp = {(r.filename, r.protein_id): r for r in R.file_proteins(p, gp).collect()}
    assert byp["f1.mzML", "P2"].protein_q == "0.001" and byp["f2.mzML", "P2"].n_psms == 1 and len(byp) == 3
    names = spark.createDataFrame([("f1.mzML",), ("f2.mzML",), ("A_NaCl_18_x.mzML",)], "filename string")
    s = {r.filename: r for r in R.file_summary(R.files(names), p, R.file_peptides(p, q, g), R.file_proteins(p, gp), q).collect()}
    assert (s["f1.mzML"].n_psms, s["f1.mzML"].n_peptides, s["f1.mzML"].n_proteins, s["f1.mzML"].n_quant_rows) == (1, 2, 2, 2)
    assert (s["A_NaCl_18_x.mzML"].n_psms, s["A_NaCl_18_x.mzML"].fraction, s["A_NaCl_18_x.mzML"].replicate) == (0, "NaCl", "18")


def test_flanks(spark):
    ask = spark.createDataFrame([("PEK", "P1"), ("PEK", "P9"), ("ZZ", "P1")], "peptide string, protein string")
    digest = spark.createDataFrame([("P1", "PEK", "K", "A"), ("P0", "PEK", "-", "R")], "protein string, peptide string, left_flank string, right_flank string")
    assert {(r.peptide, r.protein, r.left_flank, r.status) for r in R.flank_lookup(ask, digest).collect()} == {("PEK", "P1", "K", "protein"), ("PEK", "P9", "-", "peptide"), ("ZZ", "P1", "", "missing")}


def test_order_tells_the_last_row(spark, tmp_path):
    lines = ["psm_id\tv", *[f"{i % 500}\t{i}" for i in range(40_000)]]
    (tmp_path / "rows.tsv").write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = files.read_tsv(spark, str(tmp_path / "rows.tsv"), order=True)
        assert rows.rdd.getNumPartitions() > 3
        last = rows.groupBy("psm_id").agg(F.max_by("v", "_order").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {int(r.psm_id): int(r.v) for r in last} == {i: 39_500 + i for i in range(500)}
