"""Motif index files: blocks, offsets and the round trip."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.sources import postings


def block(ids):
    """The format, byte by byte."""
    out = bytearray()
    for v in [len(ids), *[b - a for a, b in zip([0, *ids], ids)]]:
        while v > 127:
            out.append(v % 128 + 128)
            v //= 128
        out.append(v)
    return bytes(out)


@given(st.lists(st.integers(0, 2**40), unique=True).map(sorted))
def test_decoded(ids):
    assert postings.decoded(block(ids)) == ids


def test_decoded_ends_at_its_count():
    assert postings.decoded(b"") == []
    assert postings.decoded(b"\x80") == []
    assert postings.decoded(b"\x01\x05\x07") == [5]


def test_encoded(spark):
    cases = [[], [0], [127], [128], [0, 1, 128, 16384, 2**31, 2**40], list(range(0, 900, 3)), None]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<bigint>").select("i", postings.encoded(F.col("ids")).alias("b")).collect()
    assert {r.i: None if r.b is None else bytes(r.b) for r in got} == {i: None if c is None else block(c) for i, c in enumerate(cases)}


def test_round_trip(spark, tmp_path):
    want = {f"A{chr(65 + i % 26)}{i}": sorted({(i * j) % 977 for j in range(1, 1 + i % 40)} | {i}) for i in range(300)}
    rows = [(m, p) for m, ids in want.items() for p in ids]
    rows += [rows[0], ("AA0", None), (None, 3)]
    postings.write_index(spark.createDataFrame(rows, "motif_text string, protein_id bigint"), str(tmp_path / "x"))
    got = postings.read_index(spark, str(tmp_path / "x")).collect()
    assert {r.motif_text: r.ids for r in got} == want
    assert all(r.protein_count == len(r.ids) for r in got)
    assert [r.motif_text for r in sorted(got, key=lambda r: r.motif_id)] == sorted(want)
    assert (tmp_path / "x" / "postings.bin").read_bytes() == b"".join(block(want[m]) for m in sorted(want))


def test_empty_index(spark, tmp_path):
    postings.write_index(spark.createDataFrame([], "motif_text string, protein_id bigint"), str(tmp_path / "x"))
    assert postings.read_index(spark, str(tmp_path / "x")).collect() == []
