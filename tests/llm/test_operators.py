"""Small cases with brute-force answers: nulls, empty and odd texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectraloom.llm import bpe, chat, crf, lines, maxent, media, mixing, multiset, partenum, warc, words

LONG = " ".join(f"w{i % 997}x{i}" for i in range(3000))
DOCS = [(1, None, "a"), (2, "", "a"), (3, "One line here is long.\nshared boilerplate line\n", None), (4, " Shared Boilerplate LINE \nother é text", "b"), (5, LONG, "b"), (6, LONG + " tail", "b"), (6, LONG + " tail", "b"), (None, "shared boilerplate line", "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def test_lines(spark, docs):
    got = lines.dedup_lines(docs.withColumn("n_lines", F.lit("clash")).withColumn("_x", F.lit(1)))
    assert got.count() == len(DOCS)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text == DOCS[2][1] and by[4].text == "other é text" and by[4].n_dropped == 1
    assert by[1].text == "" and by[1].n_lines == 1 and by[None].text == "shared boilerplate line"
    assert lines.dedup_lines(docs.limit(0)).count() == 0


SPLIT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def splitting(spark):
    """A session in which a join splits even small partitions that stand out."""
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ran(df):
    """The plan that ran, after its rows came."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_common_line_is_split(splitting):
    """Each document holds one very common line: the join with it is dealt to several tasks."""
    rows = [(i, f"the one very common line\nown line number {i} {j}") for i in range(20_000) for j in (1,)]
    frame = splitting.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got, plan = _ran(lines.dedup_lines(frame))
    assert "skew=true" in plan
    assert sum(r.n_dropped for r in got) == len(rows) - 1 and {r.doc_id: r.text for r in got}[7] == "own line number 7 1"


def test_lines_keeps_clashing_columns(spark):
    names = ["_id", "_row", "_lines", "_drop", "_in", "_pos", "_h1", "_first", "_x"]
    frame = spark.createDataFrame([(1, "shared line of text"), (2, "shared line of text\nx")], "doc_id long, text string")
    got = lines.dedup_lines(frame.select("doc_id", *[F.lit(i).alias(c) for i, c in enumerate(names)], "text"))
    assert got.columns == ["doc_id", *names, "text", "n_lines", "n_dropped"]
    assert {(r.doc_id, r._id, r._x, r.text) for r in got.collect()} == {(1, 0, 8, "shared line of text"), (2, 0, 8, "x")}


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "<\\\\|a", "", None, "<", "tail <", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner%0A<", t) for i, t in enumerate(odd)] + [(2, None, None, "x"), (2, None, None, "x")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)))
    made = chat.format_turns(turns)
    read = {r.conv_id: r for r in made.withColumn("read", chat.parse_formatted(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in read[1].read] == [(r[2], r[3] or "") for r in rows[:8]]
    spans = [read[1].formatted[s.start : s.start + s.length] for s in read[1].loss_spans]
    assert [re.sub(r"<(\\*)\\\|", r"<\1|", s) for s in spans] == [odd[i] or "" for i in (1, 3, 5, 7)]
    d = {r.conv_id: r for r in chat.digests(made).collect()}
    learnt = "".join(odd[i] or "" for i in (1, 3, 5, 7))
    assert d[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and d[1].loss_chars == len(learnt)
    assert d[2].n_turns == 2


def test_chat_layouts(spark):
    m = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")])], "conv_id long, messages array<struct<role:string,content:string>>")
    v = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    p = spark.createDataFrame([(1, "a", "b")], "conv_id long, prompt string, completion string")
    i = spark.createDataFrame([(1, "a", None, "b")], "conv_id long, instruction string, input string, output string")
    for frame in (m, v, p, i):
        assert [(r.role, r.text) for r in chat.canonical_turns(frame).orderBy("turn").collect()] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1,)], "x long").schema)


def test_warc(spark, tmp_path):
    big = "é<html>" * 50
    pages = spark.createDataFrame([(5, "u", big), (3, None, big), (9, "a\nb", "short"), (8, "c", "short"), (7, "d", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert (got[3].record_type, got[5].record_type, got[5].refers_to) == ("response", "revisit", 3)
    assert got[5].payload_bytes == len(big.encode()) and got[5].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert got[9].record_type == got[8].record_type == "response" and got[7].payload_digest == warc.EMPTY_DIGEST
    assert warc.round_trip(pages.limit(0)).count() == 0
    one = warc.make_record(1, "u", b"x" * 200_000, hashlib.sha256(b"x" * 200_000).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert len(warc.parse_bytes(one * 2)) == 2
    wrong = warc.make_record(1, "u", b"abc", "0" * 64, None, "2024-01-01T00:00:00Z")
    for bad in (one[:-5], wrong):
        with pytest.raises(warc.WarcError):
            warc.parse_bytes(bad)


def test_warc_digests():
    """SHA-256 in hexadecimal, SHA-1 in base 32; what carries no digest is refused unless that is asked for."""
    import base64

    made = zlib.decompress(warc.make_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z"), 31)

    def packed(text):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(text) + packer.flush()

    without = packed(re.sub(rb"WARC-(Payload|Block)-Digest: [^\r]*\r\n", b"", made))
    with pytest.raises(warc.WarcError):
        warc.parse_bytes(without)
    assert [r.payload for r in warc.read_records(__import__("io").BytesIO(without), unverified=True)] == [b"abc"]
    for data, ok in ((b"abc", True), (b"abd", False)):
        sha1 = b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())
        other = packed(re.sub(rb"(WARC-Payload-Digest: )[^\r]*", rb"\g<1>" + sha1, made))
        if ok:
            assert warc.parse_bytes(other)[0].payload == b"abc"
        else:
            with pytest.raises(warc.WarcError):
                warc.parse_bytes(other)


def test_warc_copies_and_missing_ids(spark):
    """A third of the pages are one payload; ids are null or repeated; other columns clash with the operator's."""
    big, other = "copied page " * 20, "other page " * 20
    rows = [(i, "u", big if i % 3 == 0 else f"page {i} " * 20) for i in range(10, 310)] + [(None, "n", big), (None, "n", other), (400, "a", other), (400, "a", other), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("payload", "refers_to", "_first", "_page")])
    planned = warc.plan_records(frame)
    assert "Exchange hash" not in planned._jdf.queryExecution().executedPlan().toString()  # payloads stay where they are
    got = warc.round_trip(frame).collect()
    assert len(got) == len(rows)
    assert {r.refers_to for r in got if r.page_id and r.page_id < 400 and r.page_id % 3 == 0} == {12, None}
    assert Counter(r.refers_to for r in got if r.page_id is None) == {12: 1, 400: 1, None: 1}
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 400] == [("response", None)] * 2


def test_signatures_meet():
    """Sets that link share a signature, whatever their sizes: the guarantee the join rests on."""
    rng = np.random.default_rng(1)
    for percent in (90, 80):
        for n in (1, 4, 9, 10, 19, 33, 70, 150, 400, 1500):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                    assert np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)).size


def test_large_bands_sign_subsets():
    for percent in (90, 80):
        large = [b for b in partenum.bands(percent, 2000) if b.largest > 40]
        assert all(b.skip >= 1 and b.parts > b.skip for b in large)
        # A shingle in each partition differs: whole partitions would not agree, subsets of their parts do.
        band, rng = large[-1], np.random.default_rng(2)
        a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) << np.uint64(1))
        place = ((a >> np.uint64(32)) * np.uint64(band.partitions)) >> np.uint64(32)
        b = np.delete(a, np.unique(place, return_index=True)[1])
        assert np.intersect1d(partenum.sign(a, band), partenum.sign(b, band)).size


def test_unlike_sets_share_no_signature():
    """Subsets of parts that hold no shingle sign alike: they are replaced, so that unlike sets do not meet there."""
    rng = np.random.default_rng(3)
    for percent in (90, 80):
        for n in (12, 30, 60):
            seen = Counter()
            for _ in range(1000):
                shingles = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
                seen.update(set(partenum.signatures(shingles, percent).tolist()))
            assert max(seen.values()) <= 5


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_like_brute_force(spark, k, percent):
    """Every pair compared: copies, near copies in chains, short and empty texts, one large group of near copies."""
    rng = np.random.default_rng(k)

    def text(n):
        return [f"t{x}" for x in rng.integers(0, 10**6, n)]

    made = []
    for n in [0, 1, 2, 4, 7, 12, 20, 33, 60, 150, 400]:
        for _ in range(3):
            base = text(n)
            made += [base, list(base)]
            for _ in range(4):  # each a step further from the first
                base = list(base)
                for _ in range(max(1, n // 70)):
                    if base:
                        base[rng.integers(0, len(base))] = f"n{rng.integers(0, 10**6)}"
                made.append(base)
    large = text(200)
    made += [[*large[:i], f"one{i}", *large[i + 1 :]] for i in range(0, 200, 2)]
    order = rng.permutation(len(made))
    texts = [" ".join(made[i]) for i in order]
    frame = spark.createDataFrame([(int(i) * 7, t or None, "a") for i, t in enumerate(texts)], SCHEMA)
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similarity_components(frame, k, percent).collect()}
    assert got == {i * 7: (len(s), find(i) * 7) for i, s in enumerate(sets)}
    with pytest.raises(ValueError, match="integral"):
        partenum.similarity_components(frame.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_common_signatures_are_summed_up_before_they_are_dealt(spark):
    """A signature that all documents share: a task sends one row of it by its own key, the others spread."""
    shared = " ".join(f"c{i}" for i in range(300))
    frame = spark.createDataFrame([(i, shared + f" u{i}") for i in range(2000)], "doc_id long, text string").coalesce(2)
    rows = partenum.signed_rows(frame, 5, 80)
    assert rows.groupBy("deal").count().agg(F.max("count")).first()[0] <= 2
    assert rows.groupBy(F.coalesce(F.get("met", F.lit(0)), "deal")).count().agg(F.max("count")).first()[0] > 1500


def test_signed_rows_are_packed_before_they_are_dealt(spark):
    """Ids come back whole, the key's upper 48 bits stay, one exchange moves 16 bits less a row."""
    ids = [0, 1, 65_535, 65_536, -1, -65_537, 2**63 - 1, -(2**63)]
    rows = [(deal, b, [7, 8, 9] if b == 1 else None) for b in ids for deal in (5 << 16 | 3, -(5 << 16) | 3, 2**63 - 1)]
    frame = spark.createDataFrame(rows, "deal long, b long, met array<long>")
    dealt = partenum.dealt_out(frame)
    assert sorted((r.deal, r.b, r.met) for r in dealt.where("met IS NULL").collect()) == sorted((d >> 16, b, m) for d, b, m in rows if m is None)
    assert dealt.where("met IS NOT NULL").select("b", "met").distinct().collect() == [(1, [7, 8, 9])]
    window = dealt.withColumn("a", F.first("b").over(Window.partitionBy("deal").orderBy("b")))
    assert window._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in partenum.packed(frame).where("x = 5 << 16 | 65535").select("y").collect()} == {(0,), (-1,), (-2,), (2**47 - 1,)}


def test_components_of_texts(spark, docs):
    near = [(i, " ".join(f"v{(j * (1 if j != i * 7 else 31)) % 5000}" for j in range(400)), "z") for i in range(100, 140)]
    frame = docs.unionByName(spark.createDataFrame(near, SCHEMA))
    got = {r.doc_id: r.component_id for r in partenum.similarity_components(frame, 5, 80).collect()}
    assert got[5] == got[6] == 5 and got[1] == 1 and got[2] == 2 and got[None] is None
    assert {got[i] for i in range(100, 140)} == {100}
    kept = partenum.drop_near_duplicates(frame.withColumn("b", F.lit(1)), 5, 80)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, None, 100}
    assert partenum.similarity_components(docs.limit(0)).count() == 0


def test_word_hashes():
    texts = ["A  b\tc\x0bA", "", "é\x00 é", " x"]
    h, at = words.hash_words([t.encode() for t in texts])
    assert Counter(at.tolist()) == {0: 4, 2: 2, 3: 1} and h[0] == h[3] and h[4] != h[5]


def test_bpe_like_tiktoken(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["", "it's  'll\n\n x", "  ", "a" * 3000, "'s's''s", "é ½ 漢😀  x　", LONG]
    for t, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t) and codec.decode(ids) == t.encode()
    out = bpe.encode_documents(docs.withColumn("ids", F.lit("clash")), path, offsets=True)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "offsets"] and out.count() == len(DOCS)
    assert {r.text for r in bpe.decode_documents(out, path).collect()} == {d[1] or "" for d in DOCS}


def test_multiset(spark, docs):
    frame = spark.createDataFrame([(1, "a\nb\nc"), (2, "c\na\nb"), (3, "a\nb"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r.l for r in frame.select("doc_id", multiset.lanes(F.col("text")).alias("l")).collect()}
    assert got[1] == got[2] != got[3]
    both = spark.createDataFrame([(got[3], got[4], got[1])], "a array<long>, b array<long>, c array<long>")
    row = both.select(multiset.combine(F.col("a"), F.col("b")).alias("sum"), multiset.combine(F.col("c"), F.col("b"), remove=True).alias("less")).first()
    assert row["sum"] == got[1] and row["less"] == got[3]
    texts = {1: "", 2: "x" * 5, 7: "yz", 9: "é. b. c"}
    rows = spark.createDataFrame([(k, v or None) for k, v in texts.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in multiset.edited_pairs(rows).collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        t, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        assert out[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert multiset.edited_pairs(docs).count() == len(DOCS) and multiset.edited_pairs(docs.limit(0)).count() == 0


def test_next_rows_of_clustered_ids(spark):
    """One id far off does not put the others into one range; null, repeated ids and clashing columns are kept apart."""
    ids = [*range(5000), 10**15, -(10**15), 77, None]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    bounds = [0, 500, 1000, 2000, 4000]
    spread = frame.groupBy(multiset._range_of(F.col("doc_id"), bounds).alias("r")).count().collect()
    assert {r.r: r["count"] for r in spread} == {-1: 1, 0: 1, 1: 501, 2: 500, 3: 1000, 4: 2000, 5: 1001}
    got = multiset.with_next(frame.withColumn("_range", F.lit(1)), "doc_id", "text", {"_n": F.length("_text")}, per_range=64)
    order = sorted(ids, key=lambda i: (i is not None, i))
    after = Counter((a, f"t{b}") for a, b in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.next_text) for r in got.collect()) == after
    # No task reads more than its range of ids, whatever their number: none gathers all.
    few, many = (multiset._id_bounds(spark.range(n, numPartitions=8).select(F.col("id").alias("_id")), n, 64, 65_536) for n in (10_000, 40_000))
    assert 100 <= len(few) <= 200 and 500 <= len(many) <= 700 and many == sorted(set(many))
    with pytest.raises(ValueError, match="integral"):
        multiset.edited_pairs(frame.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_media():
    for n in (0, 1, 64, 65, 2048, 5000):
        raw = os.urandom(n)
        found, frames = media.decode_avi(media.encode_avi(media.pad(raw)))
        assert media.read_payload(found, frames) == media.pad(raw)
    samples = np.arange(256, dtype=np.uint8).reshape(4, 64)
    frame = media.encode_frame(samples)
    assert (media.decode_frame(frame) == samples).all()
    dc = (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))
    scan = frame[frame.index(media._SOS) + len(media._SOS) : -2].replace(b"\xff\x00", b"\xff")
    assert [v + 128 for v in media._slow_levels(scan, 256, dc, (bytes([1] + [0] * 15), b"\0"))] == list(range(256))
    assert media.shots([np.zeros((2, 2), np.uint8)] * 3 + [np.full((2, 2), 200, np.uint8)] * 2) == [(0, 2), (3, 4)]


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    model = crf.Crf(rng.normal(size=crf.WIDTH), rng.normal(size=(2, 2)))
    features, _, counts = crf.line_features(["a b\nC!!\n| x", "", "one"])
    got = model.marginals(features, counts)
    at = 0
    for n in counts:
        e = features[at : at + n] @ model.weights
        total, good = 0.0, np.zeros(n)
        for y in np.ndindex(*[2] * n):
            p = math.exp(sum(e[i] * y[i] for i in range(n)) + sum(model.transitions[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_crf_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scored = crf.score_documents(docs.withColumn("score", F.lit(9)), crf.train(docs, labels))
    assert [r.score for r in scored.collect()] == [0.5] * len(DOCS)


def test_maxent_base(spark, docs):
    got = maxent.score_documents(docs).collect()
    assert len(got) == len(DOCS)
    counts, toks = Counter(), []
    for i, t, _ in DOCS:
        w = (t or "").encode().lower().split() + [b"\n"]
        toks.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in toks)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert maxent.score_documents(docs.limit(0)).count() == 0


def test_maxent_finds_every_frequent_word(spark):
    hashes = [5 << 46, (9 << 46) + 1, (9 << 46) + 2]  # the last two share a prefix
    vocabulary = maxent.make_vocabulary(spark.createDataFrame([(h, 7, 0) for h in hashes], "h long, c long, e int"))
    at, known = vocabulary.find(np.array([*hashes, (9 << 46) + 3, 3 << 46, (1 << 64) - 1], np.uint64))
    assert known.tolist() == [True] * 3 + [False] * 3 and at[:3].tolist() == [0, 1, 2]


def test_maxent_grows_with_the_vocabulary(spark):
    def made(n):
        h = (F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))).alias("h")
        return maxent.make_vocabulary(spark.range(n).select(h, F.lit(1).cast("long").alias("c"), F.lit(0).alias("e")))

    few = made(2000)
    assert (few.head >= 0).sum() == 1024 and few.shape.classes == 64  # 768 words and 48 classes are too few
    small, large = maxent.Shape.of(10**5), maxent.Shape.of(10**7)
    assert all(getattr(large, k) > getattr(small, k) for k in ("head", "classes", "kinds", "pairs", "word_rows"))
    # The rows stay in the tables of a shape whose word rows are hashed, and learning fits what it sees.
    shape = maxent.Shape(72)
    assert shape.word_rows < shape.side * shape.kinds
    side, head = shape.side, shape.head
    v = maxent.Vocabulary(shape, 0, 0, *[np.zeros(0, np.int64)] * 5, np.zeros(side), np.zeros(2 * side, np.float32), np.zeros((side, side), np.float32))
    kinds, counts = np.array([0, head - 1, head, head + side - 1] * 50), np.array([200])
    assert 3 * shape.kinds <= maxent.features(shape, kinds, counts)[:, 3].min() and maxent.features(shape, kinds, counts).max() < shape.rows - 1
    start = weights = maxent.Weights.start(v)
    before = maxent.log_probabilities(start, v, kinds, counts).sum()
    for _ in range(5):
        sums = maxent.Sums(v, weights)
        sums.add(kinds, counts)
        sums.settle()
        weights = maxent.stepped(weights, *[x.astype(np.float64) for x in sums.tables], 0.3)
    assert maxent.log_probabilities(weights, v, kinds, counts).sum() > before
    sums = maxent.Sums(v)
    sums.add(kinds, counts)
    sums.settle()
    counted = maxent.start_weights(v, *sums.tables)
    assert maxent.log_probabilities(counted, v, kinds, counts).sum() > before


def _spoken(n=120):
    rng = np.random.default_rng(5)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60 + i) if x < 400) or None, "a") for i in range(n)]


def test_maxent_scores_like_a_plain_walk(spark, docs):
    """Every token's class and word probability, computed one by one from the model's tables."""
    frame = spark.createDataFrame(_spoken(), SCHEMA).unionByName(docs)
    rows = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = maxent.train(maxent.tokenise(rows, 2), 2)
    v, w = model.vocabulary, model.weights
    shape = v.shape
    counts = {r.h & (1 << 64) - 1: r.c for r in model.counts.collect()}

    def kind(h, ending):
        at = np.flatnonzero(v.words == h)
        place = v.head[at[0]] if len(at) else -1
        return int(place) if place >= 0 else shape.head + int(v.tail_class[ending])

    def walk(text):
        tokens, endings, _ = maxent.tokens_of([text.encode().lower()])
        kinds, total = [kind(*x) for x in zip(tokens, endings)], 0.0
        for i, k in enumerate(kinds):
            before = [kinds[i - j] if i >= j else shape.kinds - 1 for j in (1, 2, 3)]
            on = [j * shape.kinds + b for j, b in enumerate(before)]
            pair = maxent.mix64(np.array([on[0] * shape.kinds + on[1] + 1], np.uint64))[0] % np.uint64(shape.pairs)
            on += [3 * shape.kinds + int(pair), shape.rows - 1]
            x = w.classes[on].astype(np.float64).sum(axis=0)
            named = k // shape.side if k < shape.head else k - shape.head + shape.side
            total += (x[named] - np.log(np.exp(x).sum())) / math.log(10)
            if k < shape.head:
                assert shape.word_rows == shape.side * shape.kinds
                y = w.words[named * shape.kinds + before[0]].astype(np.float64) + v.word_logits[named]
                total += (y[k % shape.side] - np.log(np.exp(y).sum())) / math.log(10)
            else:
                total += math.log10(counts.get(int(tokens[i]), 0) + 1) - v.tail_log[k - shape.head]
        return total

    got = sorted((r.doc_id is None, r.doc_id, r.score) for r in maxent.score_documents(frame).collect())
    want = sorted((i is None, i, walk(t or "")) for i, t, *_ in [*_spoken(), *DOCS])
    assert len(got) == len(want) and all(a[1] == b[1] and math.isclose(a[2], b[2], rel_tol=1e-4) for a, b in zip(got, want))


def test_maxent_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(_spoken(), SCHEMA)
    one, many = (sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in maxent.score_documents(frame.repartition(n)).collect()) for n in (1, 16))
    assert [x[:2] for x in one] == [x[:2] for x in many]
    assert all(math.isclose(a, b, rel_tol=1e-6) for x, y in zip(one, many) for a, b in zip(x[2:], y[2:]))


def test_maxent_learns_and_refuses_text_ids(spark):
    rows = [(i, " ".join(["the cat sat on a mat", "a dog ran to the door"][(i + j) % 2] for j in range(30)), "a") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    held = maxent.score_documents(frame).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.8 * held[1]
    with pytest.raises(ValueError, match="integral"):
        maxent.score_documents(frame.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_mixing(spark, docs):
    rows = [(i, "x" * 40, "big" if i < 900 else "small") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    uses = Counter(r.doc_id for r in mixing.mix(frame, max_repeats=3.0).collect())
    assert all(uses[i] == 1 for i in range(900)) and sum(uses[i] for i in range(900, 1000)) in range(280, 301) and max(uses.values()) <= 4
    budget = mixing.mix(frame, budget=5000, target_entropy=math.log(2) * 0.99, max_repeats=None, detail=True).collect()
    size = Counter(r.source for r in budget)
    assert 4900 <= sum(r._tokens for r in budget) <= 5001 and size["small"] > 180
    # The documents taken in a part of a pass are those first in its permutation.
    cut = spark.createDataFrame([("k", (1 << 51) * i, 10) for i in range(4096)], "_key string, _u long, _size long")
    rest = spark.createDataFrame([("k", 205)], "_key string, _rest long")
    assert mixing.cut_points(cut, rest).first()._cut // (1 << 51) == 19
    # Without a budget every document is used, those of small sources (null is one) up to four times.
    uses = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert set(uses) == {d[0] for d in DOCS} and max(uses.values()) <= 4 and uses[5] == 1
    assert mixing.mix(docs, max_repeats=1.0).count() == len(DOCS) and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_below_the_entropy_of_the_corpus(spark):
    sizes = {"a": 260, "b": 250, "c": 240, "d": 250}
    rows = [(i, "x" * 40, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    frame = spark.createDataFrame(rows, SCHEMA)

    def entropy(x):
        w = np.array(list(sizes.values())) ** x
        return -(w / w.sum() * np.log(w / w.sum())).sum()

    shares = frame.groupBy(mixing.source_key(F.col("source")).alias("_key")).agg(F.sum(mixing.default_tokens(F.col("text"))).alias("_tokens"))
    x, h, _ = mixing.find_exponent(shares, 10_000, 10_000, 1.2, 4.0)
    assert x > 1 and abs(entropy(x) - 1.2) < 1e-4 and abs(h - 1.2) < 1e-4
    used = Counter(r.source for r in mixing.mix(frame, budget=10_000, target_entropy=1.2).collect())
    want = np.array([260, 250, 240, 250]) ** x
    assert all(abs(used[s] - 1000 * w) < 2 for s, w in zip("abcd", want / want.sum()))
    # Without a budget every document is used; the largest source is the one that repeats.
    uses = Counter(r.doc_id for r in mixing.mix(frame, target_entropy=1.38).collect())
    assert len(uses) == 1000 and {uses[i] for i in range(510, 750)} == {1} and max(uses.values()) == max(uses[i] for i in range(260)) > 1
    with pytest.raises(ValueError, match="cannot both be met"):
        mixing.mix(frame, budget=10_000, target_entropy=0.3, max_repeats=2.0)
    with pytest.raises(ValueError, match="equal in size"):
        mixing.mix(frame.where("source IN ('b', 'd')"), budget=5000, target_entropy=0.6)
    # Two sources of a size leave ln 2 at least: the nearest mixture uses each document once, as a budget of all asks.
    uses = Counter(r.doc_id for r in mixing.mix(frame.where("source IN ('b', 'd')"), budget=5000, target_entropy=0.6, nearest=True).collect())
    assert len(uses) == 500 and set(uses.values()) == {1}
    # The limit on repeats holds where both cannot.
    uses = Counter(r.doc_id for r in mixing.mix(frame, budget=10_000, target_entropy=0.3, max_repeats=2.0, nearest=True).collect())
    assert len(uses) >= 980 and max(uses.values()) == 2


def test_mixing_query_of_tied_sources(spark, tmp_path):
    """Twenty sources of a size have no mixture of 2.8 nats; the registered query takes the nearest."""
    from spectraloom.llm import queries

    spark.createDataFrame([(i, "x" * 40, f"s{i % 20}") for i in range(200)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r.doc_id for r in queries.op4_source_mixing(spark, str(tmp_path)).collect()) == Counter(range(200))


def test_likeness_at_every_length(spark):
    rows = []
    for n in (40, 1000, 10_000, 100_000):
        a = [f"a{n} {i}" for i in range(n)]
        other = [f"b{n} {i}" for i in range(n)]
        rows.append((n, "\n".join(a), "\n".join(a[: n // 2] + other[: n // 2]), "\n".join(other)))
    frame = spark.createDataFrame(rows, "n int, a string, half string, other string").select("n", *[multiset.lanes(F.col(c)).alias(c) for c in ("a", "half", "other")])
    got = frame.select("n", multiset.likeness(F.col("a"), F.col("half")).alias("half"), multiset.likeness(F.col("a"), F.col("other")).alias("other"), multiset.likeness(F.col("a"), F.col("a")).alias("same")).collect()
    for r in got:
        assert 0.25 < r.half < 0.75 and r.other < 0.3 and r.same == 1, r
    one = spark.createDataFrame([("a\nb\nc\nd", "a\nb\nc\ne")], "a string, b string").select(multiset.likeness(multiset.lanes(F.col("a")), multiset.lanes(F.col("b"))))
    assert abs(one.first()[0] - 0.75) < 0.2
    assert multiset._parts_of()[multiset.SPARSE] < 1e-6 and abs(multiset._parts_of()[multiset.SPARSE - 1] - 1) < 1e-6


def test_chat_empty_and_missing(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = chat.digests(chat.format_turns(chat.canonical_turns(spark.createDataFrame([], schema))))
    assert empty.collect() == []
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (1, 2, "user", LONG), (1, 2, "user", LONG)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, schema).withColumn("_text", F.lit(1)).withColumn("_n", F.lit(1)))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[None].n_turns == 2 and got[None].loss_chars == 1 and got[1].n_turns == 2
    spoken = f"user\n{LONG}\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()


def test_chat_other_layouts(spark):
    q = spark.createDataFrame([(1, "a", "b")], "conv_id long, question string, answer string")
    s = spark.createDataFrame([(1, "s", "a", "b"), (2, None, "a", "b")], "conv_id long, system string, prompt string, completion string")
    assert [(r.role, r.text) for r in chat.canonical_turns(q).orderBy("turn").collect()] == [("user", "a"), ("assistant", "b")]
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(s).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]


def test_chat_json_rows(spark):
    def messages(x):
        return F.transform(x["messages"], lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))

    def prompt(x):
        return F.array(F.struct(F.lit("user").alias("role"), x["prompt"].alias("text")), F.struct(F.lit("assistant").alias("role"), x["completion"].alias("text")))

    layouts = (
        ("OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>", "messages array<struct<role:string,content:string>>", messages),
        ("OBJECT<completion: STRING, prompt: STRING>", "prompt string, completion string", prompt),
    )
    raw = ['{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', '{"prompt": "c", "completion": null}', "no json", None, '{"other": 1}']
    frame = spark.createDataFrame(list(enumerate(raw)), "conv_id long, body string")
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.json_turns(frame, "conv_id", "body", layouts).orderBy("conv_id", "turn").collect()]
    assert got == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "")]


def test_bpe_digests_like_tiktoken(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})
    rows = [*DOCS, (8, LONG * 20, "a"), (9, "x" * 5000, "a"), (10, "漢字 \u0301😀\r\n\t it's", "b")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ids_sha256", F.lit("clash"))
    got = sorted(((r.doc_id is None, r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame, path).collect())
    want = []
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        want.append(((i is None, i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), path).collect() == [] == bpe.encode_documents(docs.limit(0), path).collect()


def test_media_digests_like_plain_bytes(spark):
    rows = [*DOCS, (8, LONG * 5, "a"), (9, "é" * 32, "a"), (9, "é" * 32, "a")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_bytes", F.lit("clash"))
    got = sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.digests(frame).collect())
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode_avi(payload)
        want.append(((i is None, i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert got == sorted(want)
    assert media.digests(frame.limit(0)).collect() == [] == media.clips(media.media_column(frame.limit(0))).collect()


def test_timed_clips(spark):
    """Two scenes: shots cover all frames without gaps, and stand where the bytes change."""
    frame = spark.createDataFrame([(1, "a" * 2048 * 3 + "\x10" * 2048 * 2), (2, None)], "doc_id long, text string")
    rows = media.clips(media.media_column(frame)).orderBy("doc_id", "clip").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [(r["first"], r["last"]) for r in one] == [(0, 2), (3, 4)]
    assert [round(r.start_s * media.FPS) for r in one] == [0, 3] and round(one[-1].end_s * media.FPS) == 5
    assert [round(r["mean"]) for r in one] == [97, 16]
    assert [r.clip for r in rows if r.doc_id == 2] == [0]


def test_mixing_keeps_any_columns(spark):
    rows = [(i, "x" * 40 if i else LONG * 3, "s") for i in range(10)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("_key", "_size", "_pass", "_in", "_id")])
    got = mixing.mix(frame)
    assert got.columns == frame.columns and {r._key for r in got.collect()} == {"own"} and got.count() == 10
    with pytest.raises(ValueError, match="_pass"):
        mixing.mix(frame, detail=True)


def _mean_slope(params, args, e=1e-5):
    return [(crf.gradient(params + d, *args)[0] - crf.gradient(params - d, *args)[0]) / (2 * e) for d in np.eye(len(params)) * e]


def test_crf_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    features, _, counts = crf.line_features(["A b!\nc 1\n\n| d", "", "é f", "x\ny"])
    args = (features.astype(np.float64), counts, np.array([1, 0, 1, 0]))
    params = rng.normal(size=crf.WIDTH + 4) / 3
    assert np.allclose(crf.gradient(params, *args)[1], _mean_slope(params, args), atol=1e-6)


def test_crf_learns_whole_documents(spark):
    """Prose against junk, with a text of many lines, nulls, repeated rows, ties and clashing names; every fold comes out right."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        good = " ".join(f"word{x}" for x in rng.integers(0, 50, 40)) + ".\nAnd so it went on."
        junk = "\n".join("!!! $$$ 99" * int(rng.integers(1, 4)) for _ in range(6))
        rows.append((i, junk if i % 2 else good))
    rows += [(500, "And so it went on.\n" * 20_000), (501, None), (501, None), (None, "And so it went on.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_label", F.lit("x"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(500, 1), (501, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    model = crf.train(frame, labels.where(~crf.held_out("doc_id")))
    got = crf.score_documents(frame, model).collect()
    assert len(got) == len(rows) and {r._label for r in got} == {"x"}
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in got if r.doc_id == 501}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert crf.score_documents(frame.limit(0), model).collect() == []


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from spectraloom.llm import common

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    table = common.written(spark.range(3).toDF("n"), "some")
    assert table.count() == 3 and table._written in common._made
    common.dropped(table)
    assert table._written not in common._made and not os.path.exists(table._written.removeprefix("file:"))
