"""Substring dedup: super-k-mer partitioning of word windows, counted exactly by sorting.

A window is `window` consecutive words. Its minimiser is the smallest hash of the grams in it, so that equal
windows have equal minimisers. Consecutive windows that share one travel as one packed string to
the minimiser's bucket, where equal windows meet and are sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches, free_name, long_ids, written
from spectraloom.llm.words import _SPACE, SLICE, hash_words, mix64

WINDOW, GRAM = 20, 4
#: Windows that a bucket holds on average, and the least number of buckets.
BUCKET_WINDOWS, LEAST_BUCKETS = 40_000, 2048
#: A minimiser of more than this share of all windows, and of more than HOT_WINDOWS, is hot. There are 1 / HOT_SHARE at most.
HOT_SHARE, HOT_WINDOWS = 2.0**-15, 8_000
#: Words of a bucket that a task holds at once, and bytes of texts that it packs at once (a longer text is a piece of its own).
HELD_WORDS, PIECE_BYTES = 1_000_000, 2 << 20

_META = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<u4"), ("words", "<u4")])
#: bucket; super-k-mers (or, at bucket -1, ranges of repeated windows); their texts, a line each. Both packed by zstd.
_PACKED = "bucket long, meta_bytes long, meta binary, text_bytes long, text binary"
_RANGES = "id long, row long, start long, n long"
_R = np.uint64(0x9E3779B97F4A7C15)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _R + b)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the `n` words from each position on, by doubling; none for the last n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    power, hashed, done, out = 1, words, 0, None
    while True:
        if n & power:
            out = hashed if out is None else _joined(out[: max(0, len(hashed) - done)], hashed[done:])
            done += power
        if power * 2 > n:
            return out[: len(words) - n + 1]
        hashed, power = _joined(hashed[:-power], hashed[power:]), power * 2


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each `n` neighbours, by doubling."""
    if len(x) < n:
        return x[:0]
    power, least = 1, x
    while power * 2 <= n:
        least, power = np.minimum(least[:-power], least[power:]), power * 2
    return np.minimum(least[: len(x) - n + 1], least[n - power : n - power + len(x) - n + 1])


class Words:
    """The words of some texts: where they lie in the joined bytes, of which text they are, their hashes."""

    def __init__(self, texts: list[bytes]):
        self.whole = b"\n".join(texts)
        data = np.frombuffer(self.whole, np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.of = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        """A slice of the bytes at a time, cut between words."""
        out, at, n = [], 0, len(self.starts)
        while at < n:
            upto = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SLICE)))
            out.append(hash_words([self.whole[self.starts[at] : self.ends[upto - 1]]])[0])
            at = upto
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def numbers(self) -> np.ndarray:
        """Exact: equal words, and they alone, have equal numbers."""
        kept = np.frombuffer(self.whole, np.uint8)[~_SPACE[np.frombuffer(self.whole, np.uint8)]]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def equal_windows(numbers: np.ndarray, at: np.ndarray, window: int, hashed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the windows that start at `at` and have an equal: groups of exactly equal ones.

    Sorted by a hash and then compared word by word; should unequal windows share a hash, ranks of
    doubled lengths are sorted instead, without hashes.
    """
    hashed = gram_hashes(mix64(numbers.astype(np.uint64)), window) if hashed is None else hashed
    order, group = _alike(hashed[at])
    if len(order):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        mine, its = at[order], at[order][first][group]
        if any((numbers[mine + i] != numbers[its + i]).any() for i in range(window)):
            ranks, power = numbers, 1
            while power * 2 <= window:
                ranks, power = _ranks(ranks[:-power], ranks[power:]), power * 2
            return _alike(_ranks(ranks[at], ranks[at + window - power]))
    return order, group


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(keys) else np.zeros(0, bool)
    order, ordered = order[twin], ordered[twin]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def later(numbers: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, window: int, hashed: np.ndarray | None = None) -> np.ndarray:
    """Whether an equal of each window starts earlier: at a smaller id, or at the same and a smaller start."""
    out = np.zeros(len(at), bool)
    order, group = equal_windows(numbers, at, window, hashed)
    if len(order):
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        i, s = ids[order], starts[order]
        least = np.minimum.reduceat(i, edges)[group]
        begins = np.minimum.reduceat(np.where(i == least, s, np.iinfo(np.int64).max), edges)[group]
        out[order] = (i != least) | (s != begins)
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs in which every key, which rises by 1 or stays, goes on."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _ranges(meta: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Repeated windows as ranges; `words` is the number of windows."""
    first, length = _runs(of, starts - np.arange(len(starts)))
    out = meta[of[first]].copy()
    out["start"], out["words"] = starts[first], length
    return out


def _row(bucket: int, meta: np.ndarray, text: bytes = b"") -> tuple:
    raw = meta.tobytes()
    return bucket, len(raw), pa.compress(raw, "zstd", asbytes=True), len(text), pa.compress(text, "zstd", asbytes=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "meta_bytes", "meta", "text_bytes", "text"])


def _packed(words: Words, meta: np.ndarray, of: np.ndarray, at: np.ndarray, starts: np.ndarray, least: np.ndarray, bucket: np.ndarray, window: int) -> Iterator[tuple]:
    """A row for each bucket: the runs of windows that share a minimiser and bucket, each as one string."""
    first, length = _runs(of, starts - np.arange(len(starts)), least, bucket)
    made = meta[of[first]].copy()
    made["start"], made["words"] = starts[first], length + window - 1
    begin, end = words.starts[at[first]], words.ends[at[first] + length + window - 2]
    order = np.argsort(bucket[first], kind="stable")
    to = bucket[first][order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(to)]):
        mine = order[a:b]
        text = b"\n".join([words.whole[x:y] for x, y in zip(begin[mine].tolist(), end[mine].tolist())])
        yield _row(int(to[a]), made[mine], text)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(id and row of each, its bytes) of some texts, a piece at a time."""
    for batch in batches:
        meta = np.zeros(batch.num_rows, _META)
        meta["id"], meta["row"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        size = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column(2)), pa.int64())).to_numpy()
        first = 0
        while first < len(meta):
            upto = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + PIECE_BYTES, "right")))
            yield meta[first:upto], [t.encode() for t in batch.column(2).slice(first, upto - first).to_pylist()]
            first = upto


def _windows(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' starts, their minimisers, hashes of all windows from each word on)."""
    hashed = words.hashes()
    least = sliding_least(gram_hashes(hashed, gram), window - gram + 1)
    at = np.flatnonzero(words.of[: len(least)] == words.of[window - 1 :]) if len(least) else np.zeros(0, np.int64)
    return at, least[at], gram_hashes(hashed, window)


def count_minimisers(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(total, minimiser, windows): of each piece the windows, and minimisers of HOT_SHARE / 2 of them at least."""
    for _, texts in _texts(batches):
        _, least, _ = _windows(Words(texts), window, gram)
        kinds, n = np.unique(least, return_counts=True)
        often = n >= len(least) * HOT_SHARE / 2
        kinds, n = np.append(kinds[often].view(np.int64), 0), np.append(n[often], len(least))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) == len(n) - 1), pa.array(kinds), pa.array(n)], names=["total", "minimiser", "windows"])


def pack_windows(batches: Iterable[pa.RecordBatch], window: int, gram: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by bucket. Windows that a piece holds earlier, too, stay out: their ranges go to bucket -1.

    Windows of a hot minimiser go to a bucket of their own hash.
    """
    for meta, texts in _texts(batches):
        words = Words(texts)
        at, least, hashed = _windows(words, window, gram)
        of, starts = words.of[at], at - words.first[words.of[at]]
        twice = later(words.numbers(), at, meta["id"][of], starts, window, hashed)
        rows = [_row(-1, _ranges(meta, of[twice], starts[twice]))] if twice.any() else []
        at, least, of, starts = at[~twice], least[~twice], of[~twice], starts[~twice]
        common = np.isin(least, hot)
        key = np.where(common, hashed[at], least)
        bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
        rows += _packed(words, meta, of, at, starts, key, bucket, window)
        if rows:
            yield _batch(rows)


class _Bucket:
    """Super-k-mers of a bucket, up to HELD_WORDS; windows that repeat are put out and forgotten as more come."""

    def __init__(self, number: int, window: int, deal: int, held: int):
        self.number, self.window, self.deal, self.held = number, window, deal, held
        self.metas: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.words, self.dealt = 0, False

    def add(self, meta: np.ndarray, text: bytes) -> Iterator[tuple]:
        self.metas.append(meta)
        self.texts.append(text)
        self.words += int(meta["words"].sum())
        if self.words > self.held:
            yield from self.settle(last=False)

    def settle(self, last: bool = True) -> Iterator[tuple]:
        """Ranges of windows that start earlier elsewhere; what is left stays, or is dealt anew by its own hash if it is too much."""
        if not self.metas:
            return
        meta, words, window = np.concatenate(self.metas), Words([b"\n".join(self.texts)]), self.window
        first = np.concatenate([[0], np.cumsum(meta["words"].astype(np.int64))])
        n = np.diff(first) - window + 1
        of = np.repeat(np.arange(len(meta)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at, starts = first[of] + inside, meta["start"][of].astype(np.int64) + inside
        twice = later(words.numbers(), at, meta["id"][of], starts, window)
        if twice.any():
            yield _row(-1, _ranges(meta, of[twice], starts[twice]))
        self.metas, self.texts, self.words = [], [], 0
        if last and not self.dealt:
            return
        of, at, starts = of[~twice], at[~twice], starts[~twice]
        self.dealt |= len(at) * 2 > self.held
        if self.dealt:
            hashed = gram_hashes(words.hashes(), window)[at]
            bucket = (mix64(hashed + np.uint64(self.deal)) % np.uint64(1 << 40)).astype(np.int64)
            yield from _packed(words, meta, of, at, starts, hashed, bucket, window)
        else:
            for row in _packed(words, meta, of, at, starts, np.zeros(len(at)), np.zeros(len(at), np.int64), window):
                self.metas, self.texts = [np.frombuffer(pa.decompress(row[2], row[1], "zstd"), _META)], [pa.decompress(row[4], row[3], "zstd", asbytes=True)]
                self.words = int(self.metas[0]["words"].sum())


def settle_buckets(batches: Iterable[pa.RecordBatch], window: int, deal: int, held: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows (bucket -1), and what buckets that are too large deal anew. Rows come by bucket."""
    now: _Bucket | None = None
    for batch in batches:
        out: list[tuple] = []
        for number, meta_bytes, meta, text_bytes, text in zip(*[c.to_pylist() for c in batch.columns]):
            if number < 0:
                out.append((number, meta_bytes, meta, text_bytes, text))
                continue
            if now is None or now.number != number:
                out += now.settle() if now else []
                now = _Bucket(number, window, deal, held)
            out += now.add(np.frombuffer(pa.decompress(meta, meta_bytes, "zstd"), _META), pa.decompress(text, text_bytes, "zstd", asbytes=True))
        if out:
            yield _batch(out)
    if now and (out := list(now.settle())):
        yield _batch(out)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, meta in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            m = np.frombuffer(pa.decompress(meta, size, "zstd"), _META)
            yield pa.RecordBatch.from_arrays([pa.array(m[c].astype(np.int64)) for c in ("id", "row", "start", "words")], names=["id", "row", "start", "n"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, held: int = HELD_WORDS) -> DataFrame:
    """(id, row, start, n): runs of windows whose words also start earlier; `row` is a hash of the text, `start` counts words.

    Minimisers that many windows share are found first, from sums over tasks; the list of them is bounded by
    their share, and their windows go by their own hash. Copies inside a piece of some texts are settled there, so that
    a common passage reaches its bucket once a piece. A bucket is read in pieces; what repeats is
    forgotten between them, and what is still too much is dealt anew, in another round.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(long_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("_t")).where("id IS NOT NULL AND _t IS NOT NULL").select("id", F.xxhash64("_t").alias("row"), "_t")
    counted = rows.mapInArrow(lambda b: count_minimisers(b, window, gram), "total boolean, minimiser long, windows long")
    counted = written(counted.groupBy("total", "minimiser").agg(F.sum("windows").alias("windows")), "minimisers")
    total = counted.where("total").agg(F.sum("windows")).first()[0] or 0
    hot = counted.where(~F.col("total") & (F.col("windows") > max(HOT_WINDOWS, total * HOT_SHARE))).select("minimiser")
    hot = spark.sparkContext.broadcast(np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64))
    buckets = max(LEAST_BUCKETS, total // BUCKET_WINDOWS)
    packed = rows.mapInArrow(lambda b: pack_windows(b, window, gram, buckets, hot.value), _PACKED)
    found, deal = None, 0
    while True:
        # Ranges have nothing to meet: they stay where they are dealt, by their contents.
        spread = F.when(F.col("bucket") < 0, F.xxhash64("meta")).otherwise(F.xxhash64("bucket"))
        number = deal
        dealt = packed.repartition(spread).sortWithinPartitions("bucket")
        settled = written(dealt.mapInArrow(lambda b, number=number: settle_buckets(b, window, number + 1, held), _PACKED), "windows")
        ranges = settled.where("bucket < 0").select("meta_bytes", "meta")
        found = ranges if found is None else found.unionByName(ranges)
        packed, deal = settled.where("bucket >= 0"), deal + 1
        if not packed.head(1):
            return found.mapInArrow(_unpacked, _RANGES)


def text_words(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, held: int = HELD_WORDS) -> DataFrame:
    """Removes each word that a window covers whose words also start earlier, in a smaller id or before in the same document.

    Returns the input's columns, with the text replaced by the kept words joined by one space, and `n_words` (before), `n_removed`.
    Input columns of these two names give way; any other name may be among the input's.

    A null, empty or blank text has no words; texts of fewer words than a window lose none. Windows are judged on the input. Rows
    that share an id are versions of one document: windows that start at the same id and word are equally early,
    so that repeated rows do not remove each other. A row with a null id takes no part and keeps all its words. An empty table
    gives an empty one. A text must fit in a task's memory some ten times over.
    """
    free_name(docs, id_col, text_col)
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    found = repeated_windows(docs, id_col, text_col, window, gram, held)
    # Ranges come in any order and may overlap by their last words.
    gone = found.groupBy("id", "row").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest if c != text_col], F.lit(0).alias("")).alias("_in"),
        long_ids(docs, id_col).alias("id"),
        F.xxhash64(text).alias("row"),
        text.alias("_t"),
    )
    out = whole.join(gone, ["id", "row"], "left").select("_in", text_words(F.col("_t")).alias("_words"), "_runs")
    covered = F.flatten(F.transform("_runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] + (window - 2))))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_words").cast("long") - 1), covered)
    words = F.when(F.col("_runs").isNull(), F.col("_words")).otherwise(F.transform(stay, lambda i: F.get(F.col("_words"), i.cast("int"))))
    out = out.select("_in", F.size("_words").cast("long").alias("_n"), words.alias("_kept"))
    columns = [F.array_join("_kept", " ").alias(c) if c == text_col else F.col("_in")[c].alias(c) for c in rest]
    return out.select(*columns, F.col("_n").alias("n_words"), (F.col("_n") - F.size("_kept")).cast("long").alias("n_removed"))
