"""Byte-level BPE: boundaries by scans over transition functions, pieces by cached pair merging."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.common import bounded_batches

#: Classes of code points.
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
#: Code points with the property White_Space, but for the blank.
WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows the apostrophe of a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Characters handled at once, and pieces a worker remembers.
SLICE, CACHED = 1 << 18, 200_000


@lru_cache(None)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[WHITE] = SPACE
    table[32] = BLANK
    return table


#: States of the automaton: free, one or two characters of a contraction to come, inside a run that
#: an apostrophe cannot leave (after a blank or among other signs).
FREE, ONE, TWO, RUN = range(4)


def _packed(free: int, run: int) -> int:
    """A transition function on the four states in a byte: two bits for each state's successor."""
    return free | FREE << 2 | ONE << 4 | run << 6


#: Functions of: letters, numbers and spaces; signs and blanks; apostrophes of short and of long contractions.
_PLAIN, _SIGN, _APO1, _APO2 = _packed(FREE, FREE), _packed(RUN, RUN), _packed(ONE, RUN), _packed(TWO, RUN)


@lru_cache(None)
def _compose() -> np.ndarray:
    """compose[f << 8 | g]: first f, then g."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    out = np.zeros(1 << 16, np.int64)
    for s in range(4):
        out |= (g >> (2 * (f >> (2 * s) & 3)) & 3) << (2 * s)
    return out.astype(np.uint8)


def scan_states(functions: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each character: a prefix scan of composed transition functions.

    Composition is associative, so blocks are scanned side by side; a pass over the blocks'
    totals gives the state that each begins in.
    """
    n = len(functions)
    columns = -(-n // block)
    grid = np.full(columns * block, _packed(FREE, RUN) & 0 | 0b11100100, np.uint8)  # the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(columns, block).T)
    table = _compose()
    for i in range(1, block):
        np.take(table, grid[i - 1].astype(np.uint16) << 8 | grid[i], out=grid[i])
    entry, state = np.zeros(columns, np.uint8), FREE
    for i, f in enumerate(grid[-1].tolist()):
        entry[i] = state
        state = f >> (2 * state) & 3
    after = (grid >> (2 * entry) & 3).T.ravel()[:n]
    before = np.empty(n, np.uint8)
    before[0:1] = FREE
    before[1:] = after[:-1]
    return before


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece starts. points: code points; first: True where a text starts."""
    n = len(points)
    kind = class_table()[points]
    ahead = np.zeros(n + 2, points.dtype)
    ahead[:n] = points
    fresh = np.ones(n + 2, bool)
    fresh[:n] = first
    one, two = np.where(fresh[1 : n + 1], 0, ahead[1 : n + 1]), np.where(fresh[1 : n + 1] | fresh[2:], 0, ahead[2:])
    quote = points == 39
    functions = np.where((kind == OTHER) | (kind == BLANK), np.uint8(_SIGN), np.uint8(_PLAIN))
    if quote.any():
        short = quote & np.isin(one, [ord(c) for c in SHORT])
        long = np.zeros(n, bool)
        for a, b in LONG:
            long |= quote & (one == ord(a)) & (two == ord(b))
        functions[short], functions[long] = _APO1, _APO2
    else:
        short = long = quote
    # A text's first character forgets what came before: its function is constant.
    start = functions[first] & 3
    functions[first] = start * 0b01010101
    before = scan_states(functions)
    before[first] = FREE
    previous = np.empty(n, np.uint8)
    previous[0:1] = SPACE
    previous[1:] = kind[:-1]
    ended = np.zeros(n, bool)
    ended[1:] = before[:-1] == ONE
    white = kind >= BLANK
    next_solid = ~fresh[1 : n + 1] & np.append(~white[1:], False)
    starts = np.where(white, (previous < BLANK) | next_solid, (previous != BLANK) & ((previous != kind) | ended))
    starts &= before != TWO
    starts &= before != ONE
    return starts | first | ((short | long) & (before == FREE))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of the lowest rank is joined, the leftmost first, until none is known."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    known = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while known and (low := min(known)) < 1 << 30:
        i = known.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del known[i]
        if i < len(known):
            known[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            known[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for pieces of any length."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        live[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Piece to packed ids; forgets everything once it holds CACHED pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        found = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = found
        return found


class Codec:
    """A vocabulary of ranks, one id a rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pieces = _Pieces(self.ranks)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > SLICE:
                out += self._encode(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        data = whole.encode()
        if len(data) == len(whole):
            points = np.frombuffer(data, np.uint8)
        else:
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(boundaries(points, first))
        if len(data) == len(whole):
            offsets = starts
        else:
            wide = (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
            ends = np.cumsum(wide, dtype=np.int64)
            offsets = ends[starts] - wide[starts]
        cuts = np.searchsorted(starts, at).tolist()
        places = [*offsets.tolist(), len(data)]
        coded = list(map(self.pieces.__getitem__, [data[a:b] for a, b in zip(places, places[1:])]))
        return [b"".join(coded[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte of the text at which each token begins."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return np.cumsum(lengths) - lengths


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batches: Iterable[pd.DataFrame], column: str, rows: int = 512) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.iloc[i : i + rows]
            yield part, ["" if t is None else t for t in part[column]]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """The frame with its text replaced by `ids` (binary, little-endian 32-bit) and `n_tokens`.

    path: the ranks file, at the same place on every machine. `offsets` adds the byte at which
    each token begins. Null and empty texts have no ids. Input columns of the result's names
    give way, others of any names stay; repeated rows are coded alike, an empty table gives an empty one. No exchange;
    texts are handled in slices of about 256,000 characters, a longer one by itself.
    """
    import pyarrow as pa

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        made.append(T.StructField("offsets", T.ArrayType(T.LongType())))
    rest = [f for f in docs.schema.fields if f.name not in {text_col, *(m.name for m in made)}]
    names = [f.name for f in rest]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                coded = use.encode_batch([t or "" for t in part.column(text_col).to_pylist()])
                columns = [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())]
                if offsets:
                    columns.append(pa.array([use.offsets(c) for c in coded], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], [*names, *(m.name for m in made)])

    return docs.select(*[F.col(f"`{n}`") for n in [*names, text_col]]).mapInArrow(run, T.StructType([*rest, *made]))


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id as text, text) of packed ids; bytes that are no UTF-8 become replacement signs, null ids an empty text."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [codec(path).decode(b or b"").decode("utf-8", "replace") for b in batch["ids"]]})

    return coded.select(F.col(id_col).cast("string").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id string, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: ids of every whole text, and what they decode to.

    Null texts are empty and have no ids. Every row has a result: repeated rows repeat it, a null id
    stays null. Columns other than the two are not read. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        use = codec(path)
        for part, texts in _texts(batches, "text"):
            coded = use.encode_batch(texts)
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].to_numpy(),
                    "n_tokens": [len(c) // 4 for c in coded],
                    "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                    "decoded_sha256": [hashlib.sha256(use.decode(c)).hexdigest() for c in coded],
                }
            )

    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = plain.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
