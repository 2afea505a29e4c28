"""Mixing sources to target weights: temperature, then budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.llm.common import written

#: Sources up to which their table is broadcast; beyond, it is joined like any other.
BROADCAST_SOURCES = 10_000
#: Bits of a pass's permutation key that name the block, and the sub-block.
BITS = 12
GRID = 64
#: Powers of two up to which the exponent is sought; what is then left of the entropy is of sources equal in size.
HIGHEST = 40
#: Nats above the least entropy there is that count as nearest to a target below it.
NEAR = 1e-6


@dataclass(frozen=True)
class Plan:
    """What the temperature settled on."""

    exponent: float
    entropy: float
    repeats: float
    budget: int
    shares: DataFrame  # (_key, _tokens, _quota, _passes, _rest)
    n_sources: int


def default_tokens(text: Column) -> Column:
    """A quarter of the text's UTF-8 bytes, rounded up: a usual measure of tokens, whole texts counted."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def source_key(source: Column) -> Column:
    """Null is a source of its own, other than the empty name."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), source.cast("string")))


def _at(shares: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, highest repeats for a budget of one corpus) of each: one small aggregate."""
    p = F.col("_tokens") / F.lit(float(total))
    x = F.explode(F.array(*[F.lit(e) for e in exponents])).alias("x")
    parts = shares.where("_tokens > 0").select(x, F.log(p).alias("l"), p.alias("p"))
    # Against the largest share, so that high exponents leave it at 1.
    parts = parts.crossJoin(F.broadcast(parts.agg(F.max("l").alias("top")))).select("x", (F.col("l") - F.col("top")).alias("l"), "p")
    raised = F.exp(F.col("x") * F.col("l"))
    sums = parts.groupBy("x").agg(F.sum(raised).alias("s"), F.sum(raised * F.col("l")).alias("sl"), F.max(raised / F.col("p")).alias("r"))
    rows = sums.select("x", (F.log("s") - F.col("x") * F.col("sl") / F.col("s")).alias("h"), (F.col("r") / F.col("s")).alias("r")).collect()
    return sorted((r.x, r.h, r.r) for r in rows)


def find_exponent(shares: DataFrame, total: int, budget: int | None, target_entropy: float | None, max_repeats: float | None, rounds: int = 4, nearest: bool = False) -> tuple[float, float, float]:
    """The least exponent that meets both limits, with its entropy and repeats.

    Entropy falls as the exponent rises, and so do the repeats of the smallest source up to 1, so
    every round keeps one step of a grid of GRID: a section into 64 instead of 2.
    target_entropy: nats; weights are as flat as that and no flatter. Where shares in proportion
    (1) are flatter, the exponent is above 1, and the largest source repeats most. max_repeats: how
    often a document may be used at most. Without a target, 1 is taken where even that repeats more;
    with one, limits that cannot both be met raise a ValueError, and so does an entropy below that of
    the largest sources, equal in size, alone. With `nearest` the least exponent that comes within NEAR of the least
    entropy there is stands for such a target, and where both limits cannot be met, the one on repeats holds alone.
    Without a budget it is the least at which no source loses a document.
    """

    def repeated(row) -> float:
        x, _, r = row
        return r * (budget / total) if budget else spread[x]

    def fits(row) -> bool:
        if target_entropy is not None and row[1] > target_entropy:
            return False
        return max_repeats is None or above or repeated(row) <= max_repeats

    low, high, above = 0.0, 1.0, False
    if target_entropy is not None:
        doubled = _at(shares, total, [2.0**i for i in range(HIGHEST + 1)])
        enough = next((x for x, h, _ in doubled if h <= target_entropy), None)
        if enough is None and nearest:
            target_entropy = doubled[-1][1] + NEAR
            enough = next(x for x, h, _ in doubled if h <= target_entropy)
        if enough is None:
            raise ValueError(f"no exponent brings the sources' entropy to {target_entropy} nats: the largest, equal in size, leave {doubled[-1][1]:.6f}")
        if enough > 1:  # repeats rise from here on: the least exponent that meets the entropy repeats least
            low, high, above = enough / 2, enough, True
    best = None
    for _ in range(rounds):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        rows = _at(shares, total, grid)
        spread = {} if budget else _spread(shares, grid)
        found = next((i for i, row in enumerate(rows) if fits(row)), GRID)
        best = rows[found]
        low, high = grid[max(0, found - 1)], grid[found]
        if found == 0:
            break
    if target_entropy is not None and max_repeats is not None and repeated(best) > max_repeats * (1 + 1e-9):
        if nearest:
            return find_exponent(shares, total, budget, None, max_repeats, rounds)
        raise ValueError(f"{target_entropy} nats and at most {max_repeats} repeats cannot both be met: exponent {best[0]:.6f} has {best[1]:.6f} nats and repeats a source {repeated(best):.6f} times")
    return best


def _spread(shares: DataFrame, exponents: list[float]) -> dict[float, float]:
    """Repeats of the smallest source when the largest is used once; of the largest, the smallest used once, above 1."""
    ends = shares.where("_tokens > 0").agg(F.min("_tokens"), F.max("_tokens")).first()
    return {e: (ends[1] / ends[0]) ** abs(1 - e) for e in exponents}


def plan_mix(docs: DataFrame, source_col: str, tokens: Column, budget: int | None, target_entropy: float | None, max_repeats: float | None, nearest: bool = False) -> Plan:
    """Token shares by source, the exponent, and each source's quota of tokens."""
    counted = docs.groupBy(source_key(F.col(f"`{source_col}`")).alias("_key")).agg(F.sum(tokens).cast("long").alias("_tokens"))
    shares = written(counted, "shares")
    n, total, largest = shares.agg(F.count("*"), F.sum("_tokens"), F.max("_tokens")).first()
    smallest = shares.where("_tokens > 0").agg(F.min("_tokens")).first()[0]
    if not total:
        zero = F.lit(0).cast("long")
        return Plan(1.0, 0.0, 0.0, 0, shares.select("_key", "_tokens", zero.alias("_quota"), zero.alias("_passes"), zero.alias("_rest")), n)
    x, entropy, _ = find_exponent(shares, total, budget, target_entropy, max_repeats, nearest=nearest)
    raised = F.pow(F.col("_tokens") / F.lit(float(largest)), F.lit(x))
    scale = shares.where("_tokens > 0").agg(F.sum(raised)).first()[0]
    once = largest if x <= 1 else smallest
    whole = budget or round(once * scale / (once / largest) ** x)
    weight = F.when(F.col("_tokens") > 0, raised / F.lit(scale)).otherwise(0.0)
    # Half a token is added so that a quota of exactly one pass is not lost to rounding.
    quota = F.floor(weight * F.lit(float(whole)) + 0.5).cast("long")
    passes = F.when(F.col("_tokens") > 0, F.floor(quota / F.col("_tokens"))).otherwise(0).cast("long")
    done = shares.select("_key", "_tokens", weight.alias("_weight"), quota.alias("_quota"), passes.alias("_passes"), (quota - passes * F.col("_tokens")).alias("_rest"))
    repeats = done.agg(F.max(F.when(F.col("_tokens") > 0, F.col("_quota") / F.col("_tokens")))).first()[0]
    return Plan(x, entropy, repeats, whole, written(done, "quotas"), n)


def permutation_key(seed: int, turn: Column, *ids: Column) -> Column:
    """Where a document stands in a pass: 63 bits, the first BITS of them its block."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), turn, *ids), 1)


def _block(u: Column) -> Column:
    return F.shiftright(u, 63 - BITS)


def _sub_block(u: Column) -> Column:
    return F.shiftright(u, 63 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def cut_points(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """For each key, the largest permutation key whose prefix still fits the rest of its quota.

    rows: (_key, _u, _size). A radix select: blocks are summed, then the sub-blocks of the block
    where the rest runs out, then its rows, so that no task sorts a source. Rows of equal
    permutation keys stand or fall together. Keys whose first rows do not fit are absent.
    """

    def crossing(level: Column, of: DataFrame, left: DataFrame, name: str) -> DataFrame:
        summed = of.groupBy("_key", level.alias("_at")).agg(F.sum("_size").alias("_sum"))
        upto = F.sum("_sum").over(W.partitionBy("_key").orderBy("_at"))
        marked = summed.withColumn("_upto", upto).join(left, "_key")
        first = F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_at", (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("_left"))))
        # Without a crossing everything fits.
        return marked.groupBy("_key").agg(first.alias("_c")).select("_key", F.col("_c._at").alias(name), F.col("_c._left").alias("_left"))

    one = crossing(_block(F.col("_u")), rows, rest.select("_key", F.col("_rest").alias("_left")), "_b")
    inside = rows.join(one.select("_key", "_b"), "_key").where(_block(F.col("_u")) == F.col("_b"))
    two = crossing(_sub_block(F.col("_u")), inside, one.where("_b IS NOT NULL").select("_key", "_left"), "_s")
    deep = inside.join(two, "_key").where(_sub_block(F.col("_u")) == F.col("_s"))
    # Ties share a frame, so a tied group counts whole.
    upto = F.sum("_size").over(W.partitionBy("_key").orderBy("_u"))
    fit = deep.withColumn("_upto", upto).where("_upto <= _left").groupBy("_key").agg(F.max("_u").alias("_last"))
    floor = F.shiftleft(F.shiftleft(F.col("_b").cast("long"), BITS) + F.coalesce("_s", F.lit(0)).cast("long"), 63 - 2 * BITS) - 1
    all_fit = F.lit((1 << 63) - 1)
    return one.join(two.select("_key", "_s"), "_key", "left").join(fit, "_key", "left").select("_key", F.when(F.col("_b").isNull(), all_fit).otherwise(F.coalesce("_last", floor)).alias("_cut"))


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = 4.0,
    seed: int = 0,
    tokens: Column | None = None,
    detail: bool = False,
    nearest: bool = False,
) -> DataFrame:
    """Documents as often as the mixture uses them: a row for each use.

    Token shares are raised to the least exponent that meets the entropy and repetition
    limits. A source's quota is its weight times the budget (without one, the least budget at
    which every document is used). It is met by whole passes and one part of a pass: a pass
    is a permutation of hashed blocks and of the documents in them, drawn anew for each
    pass; the last takes documents in its order up to the quota, never beyond.

    `nearest`: limits that cannot be met (sources equal in size leave no lower entropy) give way as `find_exponent` says,
    instead of raising.

    `detail` adds _pass, _block, _tokens, which the input then may not have (ValueError); otherwise the columns
    are the input's, of any names. Null sources are one source, null texts have no tokens.
    Sources without tokens have no weight: their documents are used once without a budget, else
    not at all. Repeated rows of an id share their place in a pass. An empty table gives an empty one.
    """
    added = ("_pass", "_block", "_tokens")
    if detail and (clash := {c.lower() for c in docs.columns} & set(added)):
        raise ValueError(f"the input has columns {sorted(clash)}, which detail adds")
    size = default_tokens(F.col(f"`{text_col}`")) if tokens is None else tokens
    plan = plan_mix(docs, source_col, size, budget, target_entropy, max_repeats, nearest)
    shares = plan.shares.select("_key", F.col("_tokens").alias("_all"), "_passes", "_rest")
    near = F.broadcast if plan.n_sources <= BROADCAST_SOURCES else lambda df: df
    # The input's columns travel in a struct: no name of theirs can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col(f"`{id_col}`").alias("_id"), source_key(F.col(f"`{source_col}`")).alias("_key"), size.alias("_size"))
    u = permutation_key(seed, F.col("_passes"), F.col("_id"))
    narrow = whole.select("_id", "_key", "_size").join(near(shares.where("_rest > 0")), "_key").select("_key", u.alias("_u"), "_size")
    cuts = written(cut_points(narrow, shares.where("_rest > 0")), "cuts")
    rows = whole.join(near(shares.join(cuts, "_key", "left")), "_key")
    unweighted = F.lit(1 if budget is None else 0)
    uses = F.when(F.col("_all") == 0, unweighted).otherwise(F.col("_passes") + F.when((F.col("_rest") > 0) & (u <= F.col("_cut")), 1).otherwise(0)).cast("int")
    rows = rows.where(uses > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0), uses - 1)))
    if not detail:
        return rows.select("_in.*")
    block = _block(permutation_key(seed, F.col("_pass").cast("long"), F.col("_id")))
    return rows.select("_in.*", "_pass", block.alias("_block"), F.col("_size").alias("_tokens"))
