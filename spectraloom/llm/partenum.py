"""N-gram Jaccard join with PartEnum signatures: exact, without all pairs of a group.

Sets are put into size bands. For each band the domain of shingle hashes is cut into
partitions, so many that two sets similar enough must agree on one of them up to a few
second-level parts; the sums over subsets of those parts are the signatures. Sets that
share no signature are never compared, sets that should link always share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches, dropped, long_ids, written
from spectraloom.llm.components import connected_components
from spectraloom.llm.words import mix64, shingle_sets

#: Shingles that a signature of a band's smallest sets covers on average, where parts allow it.
COVER = 4.0
#: Rows up to which a list of ids, pairs or components is broadcast; a longer one is joined by exchange.
BROADCAST_IDS = 500_000
#: Texts' digests that a task remembers, so as to sign copies once; signatures that it sorts at once.
REMEMBERED, SORTED = 300_000, 1 << 20


@dataclass(frozen=True)
class Band:
    """How sets of at most `largest` shingles are signed: partitions, parts in each, parts left out."""

    number: int
    largest: int
    partitions: int
    parts: int
    skip: int
    spare: int


def _layout(low: int, k: int) -> tuple[int, int, int]:
    """(partitions, parts, skip) of the fewest signatures that cover COVER of `low` shingles each; else of the widest."""
    found = []
    for skip in range(1, min(k, 10) + 1):
        need = k // (skip + 1) + 1
        for parts in range(skip + 1, skip + 5):
            cover = low * (parts - skip) / (parts * need)
            found.append((cover < COVER, need * comb(parts, skip) if cover >= COVER else -cover, skip, need, parts))
    _, _, skip, need, parts = min(found)
    return need, parts, skip


@lru_cache(None)
def bands(percent: int, upto: int) -> tuple[Band, ...]:
    """Equal-size bands [l, r], r = floor(l / similarity), up to one that holds `upto`, and the next.

    Sets of sizes up to r that link differ in at most k = 2 r (100 - percent) / (100 + percent)
    shingles. Of floor(k / (skip + 1)) + 1 + spare partitions, at least spare + 1 then differ in at
    most `skip` shingles each; those agree on all but `skip` of their parts.
    """
    out, low = [], 1
    while len(out) < 2 or out[-2].largest < upto:
        high = low * 100 // percent
        k = 2 * high * (100 - percent) // (100 + percent)
        need, parts, skip = _layout(low, k) if k else (1, 1, 0)
        spare = 2 + need // 6 if need > 1 else 0
        out.append(Band(len(out), high, need + spare, parts, skip, spare))
        low = high + 1
    return tuple(out)


@lru_cache(None)
def _subsets(parts: int, skip: int) -> np.ndarray:
    """A row for each choice of `skip` parts to leave out: 1 where a part stays."""
    rows = list(combinations(range(parts), skip))
    keep = np.ones((len(rows), parts), bool)
    for i, row in enumerate(rows):
        keep[i, list(row)] = False
    return keep


def _signed(shingles: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """(signature, shingles in it) of each subset of parts, but for the thin ones that others make up for."""
    fine = band.partitions * band.parts
    place = ((shingles >> np.uint64(32)) * np.uint64(fine)) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(fine + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(shingles + np.uint64(band.number + 1)), dtype=np.uint64)])
    sums = (total[cuts[1:]] - total[cuts[:-1]]).reshape(band.partitions, band.parts)
    sizes = np.diff(cuts).reshape(band.partitions, band.parts)
    keep = _subsets(band.parts, band.skip)
    signed = np.stack([sums[:, row].sum(axis=1, dtype=np.uint64) for row in keep], axis=1)
    rest = np.stack([sizes[:, row].sum(axis=1) for row in keep], axis=1)
    name = (np.uint64(band.number) << np.uint64(40)) + np.arange(signed.size, dtype=np.uint64).reshape(signed.shape)
    made = mix64(mix64(signed) + mix64(name))
    # Signatures of few shingles say little. Of the spare + 1 partitions in which similar sets agree, one at
    # least has no signature of fewer shingles than the (spare + 1)-th thinnest partition of either
    # set; what agrees has the same size in both, so thinner signatures can go.
    floor = np.partition(rest.min(axis=1), band.spare)[band.spare] if band.spare else 0
    return made[rest >= floor], rest[rest >= floor]


def sign(shingles: np.ndarray, band: Band) -> np.ndarray:
    """Signatures of a sorted set of hashes in a band.

    Sets without shingles in a subset of parts would all sign alike there. Sets that agree on such a
    signature alone also agree on one of another cut of the domain, so it is replaced by its pairs with
    all of those.
    """
    made, rest = _signed(shingles, band)
    empty = made[rest == 0]
    if not len(empty):
        return made
    other, _ = _signed(np.sort(mix64(shingles ^ np.uint64(0x5EC0D))), band)
    return np.concatenate([made[rest > 0], mix64(mix64(empty)[:, None] + other[None, :]).ravel()])


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Of a set in its own band and as the smaller partner of a set in the next."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    known = bands(percent, 1 << (len(shingles) - 1).bit_length() if len(shingles) > 1 else 1)
    own = next(i for i, b in enumerate(known) if len(shingles) <= b.largest)
    return np.concatenate([sign(shingles, known[own]), sign(shingles, known[own + 1])])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of counters, two for each shingle and 1,024 at least, a power of two.

    Sets that differ in h shingles differ in at most h of the bits, and in nearly h where h is what links
    allow, so that few pairs of a group of copies that just do not link pass. Halves of a longer sketch
    fold into a shorter one by exclusive or.
    """
    bits = max(1024, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SIZED = "doc_id long, n_shingles long, digest binary, sketch array<long>"


def _batches(batches, k: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield part.column(0), shingle_sets([t or "" for t in part.column(1).to_pylist()], k)


def sized_sets(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: size, digest and sketch of its set."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, k):
            named = [len(s) > 0 and valid for s, valid in zip(sets, ids.is_valid().to_pylist(), strict=True)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, named, strict=True)]
            sketches = [sketch(s) if ok else None for s, ok in zip(sets, named, strict=True)]
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(run, _SIZED)


_SIGNED = "deal long, b long, met array<long>"


def signed_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(deal, b, met): documents b by signature; of equal sets that a task meets, the first alone is signed.

    Of the documents that a task holds at once and that share a signature, the smallest stands for the
    others: it is dealt out by the signature. The others have met it: they hold the signature, it as their leader
    and the next smaller one, and are dealt out evenly. So a very common signature is summed up before it is dealt.
    """
    import pyarrow as pa

    def grouped(sigs: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        sig, b = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])
        order = np.lexsort((b, sig))
        sig, b = sig[order], b[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        a = b[np.flatnonzero(first)[np.cumsum(first) - 1]]
        deal = np.where(first, sig, mix64(sig + b.view(np.uint64))).view(np.int64)
        met = np.stack([sig.view(np.int64), a, np.roll(b, 1)], axis=1)[~first]
        held = pa.ListArray.from_arrays(pa.array(3 * np.concatenate([[0], np.cumsum(~first)]), pa.int32()), pa.array(met.ravel()), mask=pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(b), held], ["deal", "b", "met"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        numbers, signed, size = [], [], 0
        for ids, sets in _batches(batches, k):
            for i, s in zip(ids.to_pylist(), sets, strict=True):
                if i is None or not len(s) or (d := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                numbers.append(i)
                signed.append(signatures(s, percent))
                size += len(signed[-1])
                if size >= SORTED:
                    yield grouped(signed, numbers)
                    numbers, signed, size = [], [], 0
        if size:
            yield grouped(signed, numbers)

    return docs.mapInArrow(run, _SIGNED)


def _top(x: Column | str) -> Column:
    return F.shiftright(x, 16)


def packed(signed: DataFrame) -> DataFrame:
    """(x, y, met) of rows (deal, b, met): the upper 48 bits of deal with the lower 16 of b, and the rest of b.

    Nearly all that is exchanged are these rows. Signatures of 48 bits that agree by chance share a bucket: that makes more
    candidates, which sizes, sketches and texts then rule out, and loses none.
    """
    low = F.col("b").bitwiseAND(F.lit(0xFFFF))
    return signed.select(F.shiftleft(_top("deal"), 16).bitwiseOR(low).alias("x"), _top("b").alias("y"), "met")


def dealt_out(signed: DataFrame) -> DataFrame:
    """(deal, b, met) dealt out by what packing keeps of deal."""
    low = F.col("x").bitwiseAND(F.lit(0xFFFF))
    return packed(signed).repartition(_top("x")).select(_top("x").alias("deal"), F.shiftleft("y", 16).bitwiseOR(low).alias("b"), "met")


def _near(table: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it if it is as short as that is meant for."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets, built again from their whole texts, are similar enough.

    A set of b goes to each of its a, whose own set goes there once.
    """
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [s.view(np.int64) for s in shingle_sets([t or "" for t in part.column(1).to_pylist()], k)]
                to = part.column(2)
                n = np.diff(to.offsets.to_numpy())
                at = pa.array(np.repeat(np.arange(part.num_rows), n))
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([to.flatten(), part.column(0).take(at), packed.take(at)], ["a", "b", "set"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.int64), np.frombuffer(other, np.int64)
                both = np.sort(np.concatenate([x, y]))  # each set has a shingle once
                shared = int((both[1:] == both[:-1]).sum())
                held.append((100 + percent) * shared >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    few = F.broadcast if pairs.count() <= BROADCAST_IDS else lambda df: df
    asked = pairs.groupBy("b").agg(F.collect_set("a").alias("to")).select(F.col("b").alias("doc_id"), "to")
    leaders = pairs.select(F.col("a").alias("doc_id")).distinct()
    own = F.array("doc_id").alias("to")
    schema = "a long, b long, set binary"
    one = docs.join(few(asked), "doc_id").select("doc_id", "text", "to").mapInArrow(run, schema)
    other = docs.join(few(leaders), "doc_id").select("doc_id", "text", own).mapInArrow(run, schema)
    both = one.join(other.select("a", F.col("set").alias("_set")), "a")
    return both.select("a", "b", "set", "_set").mapInArrow(compared, "a long, b long")


def _may_link(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """What sizes and sketches leave possible: bounds only, nothing that links is lost."""

    def fold(x: Column, y: Column) -> Column:
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    bits = F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    # Linked sets are of one band or the next, so their sketches' lengths differ by a factor of two at most.
    return F.when(sizes, apart * (100 + percent) <= (na + nb) * (100 - percent)).otherwise(False)


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, by the links 100 |A and B| >= percent |A or B|.

    A and B are the sets of distinct k-word shingles of the whole texts (all words as one
    shingle if there are fewer; A-Z lower-cased, words cut at ASCII white space). component_id
    is the smallest id that links reach. Documents without words (null and empty texts too) link with
    nothing; one with a null id gets a null component. Rows that share an id link through their own texts.
    Ids must be integral. Other columns are not read. An empty table gives an empty one.

    Equal sets are one class from the start. In every signature's bucket the smallest document
    leads; a document is compared with its leaders and its predecessors in its buckets, where sizes and
    sketches admit a link. Buckets that then hold several components are
    joined across these, again only where sizes and sketches admit a link, so a group of copies is
    never expanded into its pairs and no link between components is missed. Common keys are summed up
    before they are dealt out (signatures) or joined with written tables, which the skew join splits.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(long_ids(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    table = written(sized_sets(docs, k), "sized")
    classes = table.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    classes = written(classes, "classes")
    nodes = table.where("sketch IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["id", "n", "sketch"])

    def side(name: str) -> DataFrame:
        return nodes.select(*[F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in nodes.columns])

    admitted = _may_link(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch"), percent)

    bucket = W.partitionBy("deal").orderBy("b")
    met = [F.get("met", F.lit(i)) for i in range(3)]
    lead = F.coalesce(met[1], F.first("b").over(bucket.rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(met[2], F.lag("b").over(bucket))
    dealt = dealt_out(signed_rows(docs, k, percent)).select(F.coalesce(_top(met[0]), "deal").alias("sig"), lead.alias("a"), before.alias("p"), "b")
    shared = written(dealt.where("a <> b"), "shared")

    # The pairs of a document with its leaders, and with its predecessors where these are others.
    pair = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("p").alias("a"), "b"))).alias("x")
    pairs = shared.select(pair).where("x.a <> x.b").select("x.a", "x.b").distinct()
    pairs = written(pairs.join(side("b"), "b").join(side("a"), "a").where(admitted).select("a", "b").distinct(), "pairs")
    # Copies that several tasks signed are nodes of their own; they hang on their class's smallest.
    signed = shared.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    copies = table.where("digest IS NOT NULL").select("doc_id", "digest").join(signed, "doc_id", "left_semi").join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(verified(docs, pairs, k, percent).unionByName(copies), "links")
    found = written(connected_components(links), "found")
    near = _near(found)

    # Buckets in which several components meet still.
    members = shared.select("sig", F.explode(F.array("a", "b")).alias("id"))
    members = members.join(near, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c"))
    open_ = written(members.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig"), "open")
    members = members.join(_near(open_), "sig", "left_semi").distinct()
    members = written(members.join(nodes, "id"), "members")
    left = members.select("sig", *[F.col(c).alias(f"l_{c}") for c in members.columns if c != "sig"])
    apart = (F.col("l_id") < F.col("id")) & (F.col("l_c") != F.col("c"))
    apart = apart & _may_link(F.col("l_n"), F.col("n"), F.col("l_sketch"), F.col("sketch"), percent)
    across = left.join(members, (left["sig"] == members["sig"]) & apart).select(F.col("l_id").alias("a"), F.col("id").alias("b")).distinct()
    across = written(across.join(pairs, ["a", "b"], "left_anti"), "across")
    dropped(shared, pairs, open_, members)
    if across.head(1):
        more = written(verified(docs, across, k, percent), "links")
        if more.head(1):
            before = found
            found = written(connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "found")
            dropped(before)
        dropped(more)
    last = found.select(F.col("id").alias("rep"), "component")
    sized = table.select("doc_id", "n_shingles", "digest")
    held = sized.where("digest IS NOT NULL").join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    held = held.join(last, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = written(held.unionByName(sized.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "components")
    dropped(table, classes, links, across, found)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame with the smallest document of each component alone; its columns as they are.

    Rows of that id stay, all of them; rows with a null id stay too. Nulls, empty texts and ids: as above.
    """
    found = similarity_components(docs, k, percent, id_col, text_col)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(_near(gone), id_col, "left_anti")
