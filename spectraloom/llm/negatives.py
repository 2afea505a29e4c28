"""Hard negatives by bit-sliced integer products.

Components become integers. A block of anchors meets a group of rows whose components are cut into bit-planes; planes
are multiplied most significant first. What the planes to come can still add bounds each score from both
sides, and a candidate goes once its bounds cannot qualify.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.llm.common import free_name, long_ids, written

#: Rows of a group and anchors of a block at most, on average; groups that are aimed at, and rows that a group is worth at least.
GROUP_ROWS, BLOCK_ANCHORS, GROUPS, LEAST_ROWS = 131_072, 32_768, 64, 256
#: One row in so many is looked at first, for a floor that any result must reach.
FIRST_LOOK = 64
#: Rows and anchors multiplied at once; share of candidates below which they are followed one by one.
TILE_ROWS, TILE_ANCHORS, FEW = 4096, 256, 1 / 16

_FOUND = "anchor_id long, slot int, id long, score long"
_LOW, _HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Sizes:
    """Of the table: rows, components, bits of a component with its sign, and the type that holds all sums exactly."""

    rows: int
    components: int
    bits: int
    exact: str


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """(id, label, anchor, x) of the rows that take part, one for each id; x is floor(scale * component)."""
    part = rows.select(long_ids(rows, id_col).alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = part.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~bad)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    one = part.select("id", F.struct("label", whole.alias("x"), "anchor").alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return written(one.select("id", "r.label", "r.anchor", "r.x"), "quantised")


def sizes(table: DataFrame) -> Sizes:
    """Raises where a product of two rows could leave the range of a long."""
    largest = F.array_max(F.transform("x", lambda x: F.greatest(x, -x - 1)))
    n, d, top = table.agg(F.count("*"), F.max(F.size("x")), F.max(largest)).first()
    bits = int(top or 0).bit_length() + 1
    most = max(1, d or 0) << (2 * bits)
    if most >= 1 << 55:
        raise ValueError(f"{d} components of {bits} bits: their products do not fit")
    return Sizes(n, d or 0, bits, "float32" if most < 1 << 24 else "float64" if most < 1 << 53 else "int64")


def _matrix(lists: pa.ChunkedArray, n: int) -> np.ndarray:
    """A row for each list, zeros after its end."""
    out = np.zeros((len(lists), n), np.int64)
    at = 0
    for chunk in lists.chunks:
        long = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy()
        row = np.repeat(np.arange(len(long)), long)
        out[at + row, np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)] = flat
        at += len(long)
    return out


def planes(x: np.ndarray, bits: int, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(weight, bits of it) of two's complement integers, the sign first."""
    for b in reversed(range(bits)):
        yield (-(1 << b) if b == bits - 1 else 1 << b), ((x >> b) & 1).astype(kind)


class Tile:
    """Scores of some anchors with some rows, narrowed plane by plane to the pairs that may still be in a slot's window."""

    def __init__(self, anchors: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, k: int, size: Sizes):
        self.q, self.floors, self.ceilings, self.k, self.size = anchors.astype(size.exact), floors.copy(), ceilings, k, size
        self.up, self.down = np.maximum(anchors, 0).sum(axis=1), np.maximum(-anchors, 0).sum(axis=1)

    def _open(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Pairs that a slot's window still meets; `a` numbers their anchors."""
        out = np.zeros(np.broadcast(low, high).shape, bool)
        for j in range(self.floors.shape[1]):
            out |= (high >= self.floors[a, j]) & (low <= self.ceilings[a, j])
        return out

    def _raise_floors(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The k-th best of the pairs that are surely in a window bounds what can be among the first k."""
        for j in range(self.floors.shape[1]):
            sure = np.flatnonzero((low >= self.floors[a, j]) & (high <= self.ceilings[a, j]))
            order = sure[np.lexsort((-low[sure], a[sure]))]
            whose = a[order]
            kth = np.flatnonzero(whose[self.k - 1 :] == whose[: len(whose) - self.k + 1]) if len(whose) >= self.k else np.zeros(0, int)
            first = kth[np.flatnonzero(np.diff(whose[kth], prepend=-1))]
            self.floors[whose[first], j] = np.maximum(self.floors[whose[first], j], low[order[first + self.k - 1]].astype(np.int64))

    def pairs(self, x: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of pairs whose score is in a window, as far as floors tell."""
        left, scores, every, a, r = self.size.bits, None, np.arange(len(self.q))[:, None], None, None
        for weight, plane in planes(x, self.size.bits, self.size.exact):
            left -= 1
            rest = (1 << left) - 1
            if a is None:
                part = (self.q @ plane.T) * self.q.dtype.type(weight)
                scores = part if scores is None else scores + part
                alive = allowed & self._open(every, scores - (self.down * rest)[:, None], scores + (self.up * rest)[:, None])
                if left and alive.sum() >= FEW * alive.size:
                    continue
                a, r = np.nonzero(alive)
                scores = scores[a, r]
            else:
                scores = scores + self.q.dtype.type(weight) * np.einsum("ij,ij->i", self.q[a], plane[r])
            low, high = scores - self.down[a] * rest, scores + self.up[a] * rest
            self._raise_floors(a, low, high)
            alive = self._open(a, low, high)
            a, r, scores = a[alive], r[alive], scores[alive]
        if a is None:  # no bits at all
            a, r = np.nonzero(allowed)
            scores = np.zeros(len(a))
        return a, r, scores.astype(np.int64)


def first_of(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys))
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[rank < k]


def meet(anchors: pa.Table, rows: pa.Table, same: bool, k: int, size: Sizes) -> pa.Table:
    """The first k rows of every slot's window for a block of anchors against a group of rows."""
    ids, labels = (rows.column(c).to_numpy() for c in ("row_id", "row_label"))
    own, theirs = (anchors.column(c).to_numpy() for c in ("id", "label"))
    slots = max([1, *(len(w) for w in anchors.column("windows").to_pylist())])
    number = np.full((len(own), slots), -1, np.int64)
    floors, ceilings = np.full((len(own), slots), _HIGH), np.full((len(own), slots), _LOW)
    for i, windows in enumerate(anchors.column("windows").to_pylist()):
        for j, w in enumerate(windows):
            number[i, j], floors[i, j], ceilings[i, j] = w["slot"], w["floor"], w["ceiling"]
    x, q = rows.column("row_x"), _matrix(anchors.column("x"), size.components)
    order = np.argsort(theirs, kind="stable")
    best = [np.zeros(0, np.int64)] * 3  # (anchor * slots + slot, score, id)
    for at in range(0, len(ids), TILE_ROWS):
        of = slice(at, at + TILE_ROWS)
        tile, i, lab = _matrix(x.slice(at, TILE_ROWS), size.components), ids[of], labels[of]
        if same:
            by = np.argsort(lab, kind="stable")
            tile, i, lab = tile[by], i[by], lab[by]
        for first in range(0, len(own), TILE_ANCHORS):
            some = order[first : first + TILE_ANCHORS]
            lo, hi = (np.searchsorted(lab, theirs[some].min()), np.searchsorted(lab, theirs[some].max(), "right")) if same else (0, len(lab))
            if lo == hi:
                continue
            allowed = (theirs[some][:, None] == lab[None, lo:hi]) == same
            allowed &= own[some][:, None] != i[None, lo:hi]
            a, r, score = Tile(q[some], floors[some], ceilings[some], k, size).pairs(tile[lo:hi], allowed)
            for j in range(slots):
                inside = (score >= floors[some[a], j]) & (score <= ceilings[some[a], j])
                found = (some[a[inside]] * slots + j, score[inside], i[lo:hi][r[inside]])
                best = [np.concatenate(p) for p in zip(best, found)]
        keep = first_of(*best, k)
        best = [b[keep] for b in best]
        # The k-th best so far is the floor from here on.
        last = np.flatnonzero(best[0][k - 1 :] == best[0][: len(best[0]) - k + 1]) + k - 1 if len(best[0]) >= k else np.zeros(0, int)
        flat = floors.reshape(-1)
        flat[best[0][last]] = np.maximum(flat[best[0][last]], best[1][last])
    who, slot = best[0] // slots, best[0] % slots
    return pa.table({"anchor_id": own[who], "slot": pa.array(number[who, slot], pa.int32()), "id": best[2], "score": best[1]})


def search(anchors: DataFrame, windows: DataFrame, rows: DataFrame, same: bool, k: int, size: Sizes, n_anchors: int) -> DataFrame:
    """(anchor_id, slot, id, score): for each window the first k rows of the anchor's label, or of others, and never the anchor.

    windows: (id, slot, floor, ceiling), bounds included. Anchors go to every group of rows and rows to every block of anchors;
    groups and blocks are hashed, so that labels and ids of any spread fill them evenly.
    """
    groups = max(1, -(-size.rows // min(GROUP_ROWS, max(LEAST_ROWS, size.rows // GROUPS))))
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    asked = windows.groupBy("id").agg(F.collect_list(F.struct("slot", "floor", "ceiling")).alias("windows"))
    place = lambda n, *salt: F.pmod(F.xxhash64("id", *salt), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.join(asked, "id").select("id", "label", "x", "windows", place(blocks).alias("block"), every(groups).alias("group"))
    # Renamed: both sides come from one table.
    right = rows.select(F.col("id").alias("row_id"), F.col("label").alias("row_label"), F.col("x").alias("row_x"), every(blocks).alias("row_block"), place(groups, F.lit(1)).alias("row_group"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet(a, b, same, k, size)

    found = left.groupBy("block", "group").cogroup(right.groupBy("row_block", "row_group")).applyInArrow(cell, _FOUND)
    rank = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best(anchors: DataFrame, windows: DataFrame, rows: DataFrame, same: bool, k: int, size: Sizes, n_anchors: int, what: str) -> DataFrame:
    """As `search`, written, after a first look at one row in FIRST_LOOK: the k-th best there is a floor for the rest."""
    few = rows.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(FIRST_LOOK)) == 0)
    seen = search(anchors, windows, few, same, k, size, n_anchors).groupBy(F.col("anchor_id").alias("id"), "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    raised = windows.join(seen.where(F.col("n") == k), ["id", "slot"], "left").select("id", "slot", F.greatest("floor", "least").alias("floor"), "ceiling")
    return written(search(anchors, written(raised, "floors"), rows, same, k, size, n_anchors), what)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), scale: float = 256.0
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row for which `anchor` holds.

    Components become floor(scale * component); scores are inner products of these integers. An anchor's positives are its first `positives`
    other rows of its label, by score and then the smaller id. For each, the first `negatives` rows of other labels whose
    score is from percent[0] to percent[1] hundredths of the positive's are returned.

    Rows with a null id, label or vector, or with any null or non-finite component, take no part. Of rows that share an id, the
    first by (label, components) counts, so that repeated rows count once. A shorter vector counts as if zeros followed; an empty one
    has products of 0. Components so large that products may leave a long raise a ValueError. An empty table, or one without
    anchors, gives an empty one. Columns other than those named are not read.
    """
    free_name(rows, id_col, vector_col)
    table = quantised(rows, id_col, vector_col, F.col("label") if label is None else label, anchor, scale)
    size = sizes(table)
    anchors = table.where("anchor")
    n = anchors.count()
    open_ = anchors.select("id", F.lit(0).alias("slot"), F.lit(_LOW).alias("floor"), F.lit(_HIGH).alias("ceiling"))
    near = best(anchors, open_, table, True, positives, size, n, "positives")
    least, most = F.lit(percent[0]) * F.col("score"), F.lit(percent[1]) * F.col("score")
    windows = near.select(
        F.col("anchor_id").alias("id"),
        F.col("rank").alias("slot"),
        ((least + F.pmod(-least, F.lit(100))) / 100).cast("long").alias("floor"),
        ((most - F.pmod(most, F.lit(100))) / 100).cast("long").alias("ceiling"),
    )
    hard = best(anchors, windows.where("floor <= ceiling"), table, False, negatives, size, n, "negatives")
    hard = hard.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = near.select("anchor_id", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(chosen, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
