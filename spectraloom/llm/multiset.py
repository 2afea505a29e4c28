"""Document fingerprints: sums of wide vectors hashed from paragraphs, modulo powers of two."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.llm.common import long_ids

#: Lanes that every part adds to; lanes of which it adds to one: LEVELS groups of WIDTH.
#: The thinnest lanes take 2^-30 of the parts each: some stay as they are however many parts change in a row's text.
DENSE, LEVELS, WIDTH = 16, 28, 8
SPARSE = LEVELS * WIDTH
LANE = 0xFFFFFFFF
#: Ranges of ids whose bounds one task finds.
RANGES_A_TASK = 128


def paragraphs(text: Column) -> Column:
    """The parts that are hashed: lines, cut again after sentence ends; blank ones count too.

    Cutting at sentence ends gives documents of one line more than one part. The parts
    of a text determine nothing about order: that is the point of the hash.
    """
    return F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?])[ ]")


def _level(h: Column) -> Column:
    """The level of a hash: l with probability 2^-(l+1), so that long texts leave some levels thin."""
    # The zeros below the lowest bit that is set, the last level's bit at the latest.
    low = h.bitwiseAND(F.lit((1 << LEVELS) - 1)).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    return F.bit_count(F.bitwise_not(low).bitwiseAND(low - 1))


def lanes(text: Column) -> Column:
    """array<long> of dense + sparse lanes, each a sum modulo 2^32.

    Every part adds 64-bit hashes of its own, in two halves, to the dense lanes, and
    one to the sparse lane that its hash selects. Sums commute, so order does not
    matter; adding or subtracting a part's vector inserts or deletes it. A sum of 2^31
    parts fits a long before it is reduced.
    """
    # The parts are bound by a lambda so that the text is cut once, not once a lane.
    return F.get(F.transform(F.array(paragraphs(text)), lambda parts: _sums(parts)), F.lit(0))


def _hashed(seed: int):
    return lambda p: F.xxhash64(F.lit(seed), p)


def _sums(parts: Column) -> Column:
    low = lambda v: v.bitwiseAND(F.lit(LANE))
    zero = F.lit(0).cast("long")
    pairs = []
    for j in range(DENSE // 2):
        both = F.aggregate(
            F.transform(parts, _hashed(j)),
            F.struct(zero.alias("lo"), zero.alias("hi")),
            lambda a, h: F.struct((a.lo + low(h)).alias("lo"), (a.hi + F.shiftrightunsigned(h, 32)).alias("hi")),
            lambda a: F.array(low(a.lo), low(a.hi)),
        )
        pairs.append(both)
    hashed = F.transform(parts, lambda p: F.xxhash64(F.lit(1000), p))
    placed = F.transform(hashed, lambda h: F.struct(_level(h).alias("level"), F.shiftright(h, LEVELS).bitwiseAND(F.lit(WIDTH - 1)).alias("at"), F.shiftrightunsigned(h, 32).alias("v")))
    # Lanes are kept by level, so that a part looks at LEVELS + WIDTH places.
    summed = F.aggregate(
        placed,
        F.array_repeat(F.array_repeat(zero, WIDTH), LEVELS),
        lambda a, x: F.transform(a, lambda row, l: F.when(l == x.level, F.transform(row, lambda v, i: F.when(i == x["at"], low(v + x.v)).otherwise(v))).otherwise(row)),
        lambda a: F.flatten(a),
    )
    return F.concat(F.flatten(F.array(*pairs)), summed)


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """Lanes after the parts of b are inserted into a, or deleted from it."""
    return F.zip_with(a, b, lambda x, y: (x - y if remove else x + y).bitwiseAND(F.lit(LANE)))


def to_hex(lanes_: Column) -> Column:
    return F.array_join(F.transform(lanes_, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


@lru_cache(1)
def _parts_of() -> tuple[float, ...]:
    """For each number of sparse lanes left alone, the number of distinct parts that leave so many on average."""
    rates = [2.0 ** -(min(level + 1, LEVELS - 1)) / WIDTH for level in range(LEVELS)]

    def alone(parts: float) -> float:
        return WIDTH * sum(math.exp(parts * math.log1p(-q)) for q in rates)

    out = []
    for n in range(SPARSE + 1):
        low, high = 0.0, 2.0**40
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if alone(mid) > max(n, 0.5) else (low, mid)
        out.append(low)
    return tuple(out)


def _parts(alone: Column) -> Column:
    same = F.aggregate(alone, F.lit(0), lambda n, x: n + x.cast("int"))
    return F.get(F.array(*[F.lit(x) for x in _parts_of()]), same)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of lanes, 0 to 1: 1 less the parts that differ over the parts of both.

    Parts that differ leave as they are the lanes that they miss, parts leave at 0 those that they
    miss; every level's lanes take a known share of the parts, so the number of lanes left
    tells how many (distinct) parts there were, at any length: nearly exactly for a few,
    within about 28 % (one deviation) for many. Texts that share half of their parts have about
    0.5, unrelated ones about 0. Equal fingerprints give 1.
    """
    sparse = lambda v: F.slice(v, DENSE + 1, SPARSE)
    differ = _parts(F.zip_with(sparse(a), sparse(b), lambda x, y: x == y))
    both = _parts(F.transform(sparse(a), lambda x: x == 0)) + _parts(F.transform(sparse(b), lambda x: x == 0))
    return F.when((a == b) | (both <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - differ / both))


def _range_of(ids: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the id: a binary search; -1 for a null id.

    The bounds are one folded literal, looked into once for each power of two.
    """
    if not bounds:
        return F.when(ids.isNull(), -1).otherwise(0).cast("long")
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= ids, at + step).otherwise(at))
    return F.when(ids.isNull(), -1).otherwise(found).cast("long")


def _id_bounds(ids: DataFrame, n: int, per_range: int, most_ranges: int) -> list[int]:
    """About n / per_range of the ids, `most_ranges` and one for each task at most, in order, as many rows apart.

    Ids alone are dealt by range and sorted there; every so-manieth of a task's is a bound. No task gets more than its
    range, of RANGES_A_TASK bounds on average.
    """
    step = max(per_range, -(-n // most_ranges))
    tasks = -(-n // (step * RANGES_A_TASK))
    dealt = ids.select("_id").where("_id IS NOT NULL").repartitionByRange(max(1, tasks), "_id").sortWithinPartitions("_id")
    # The low 33 bits number a partition's rows.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sorted({r[0] for r in dealt.withColumn("_k", number).where(F.col("_k") % step == 0).select("_id").collect()})


def with_next(docs: DataFrame, id_col: str, text_col: str, derived: dict[str, Column], per_range: int = 512, most_ranges: int = 65_536) -> DataFrame:
    """(id, text, derived columns) with `next_<c>` of the row after it by (id, text); the last gets the first.

    Ids are cut into ranges of about `per_range` rows, some `most_ranges` of them at most, however the
    ids are spread. A window looks ahead inside a range; the first
    row of each range is copied to the range before it, so no task needs more than its own.
    The list of ranges is broadcast: `most_ranges` bounds it. Rows that share an id are of one range. A null id
    stands before all others. Ids must be integral. Columns other than the two are not read.
    """
    ids = long_ids(docs, id_col)
    plain = docs.select(ids.alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    n = plain.agg(F.count("_id")).first()[0]
    count = max(1, min(most_ranges, n // per_range))
    bounds = _id_bounds(plain, n, per_range, most_ranges) if count > 1 else []
    place = _range_of(F.col("_id"), bounds)
    rows = plain.withColumn("_range", place)
    firsts = plain.select("_id").withColumn("_range", place).groupBy("_range").agg(F.min("_id").alias("_first"))
    order = W.orderBy("_range")
    links = firsts.select("_range", "_first", F.lag("_range").over(order).alias("_before"), F.max("_range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_last"))
    links = links.select(F.col("_range").alias("_of"), "_first", F.coalesce("_before", "_last").alias("_to"))
    copies = rows.join(F.broadcast(links), (rows["_range"] == F.col("_of")) & rows["_id"].eqNullSafe(F.col("_first")))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies.select("_id", "_text", F.col("_to").alias("_range"), F.lit(True).alias("_copy")))
    both = both.withColumns(derived)
    # Copies come last in a range: they are the row that follows it.
    ahead = W.partitionBy("_range").orderBy("_copy", "_id", "_text")
    both = both.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in ("_text", *derived)})
    return both.where(~F.col("_copy")).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), *derived, F.col("next__text").alias(f"next_{text_col}"), *[f"next_{c}" for c in derived])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fingerprint) of every row; null texts are empty. Equal texts, equal fingerprints."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), text.alias(text_col), to_hex(lanes(text)).alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how near those and their successors are.

    The edited text has its last floor(n/2) code points replaced by as many of the next
    document's first, or all of them. A table of one document is its own successor; an empty
    table gives an empty one; repeated rows stay and follow one another.
    """
    whole = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col))
    rows = with_next(whole, id_col, text_col, {"_lanes": lanes(F.col("_text"))})
    n = F.length(text_col)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col(text_col), F.lit(1), n - half), F.substr(F.col(f"next_{text_col}"), F.lit(1), half))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), edited.alias("_edited"), "_lanes", "next__lanes")
    rows = rows.select(id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_lanes", lanes(F.col("_edited")).alias("_edited_lanes"), "next__lanes")
    return rows.select(
        id_col,
        "n_chars",
        "edited_sha256",
        to_hex(F.col("_lanes")).alias("fingerprint"),
        to_hex(F.col("_edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("_lanes"), F.col("_edited_lanes")).alias("near_edited"),
        likeness(F.col("_lanes"), F.col("next__lanes")).alias("near_next"),
    )
