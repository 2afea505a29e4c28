"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is its class's, given hashed n-gram and skip features of the tokens
before it, times its own within the class. Frequent words share classes of equal size, in which
a second softmax looks at the token before. All other words are put into classes by their
endings; within those a word counts as often as it did in training, plus one, so that
unknown words have a share as well and every text a probability. Classes, their words and the
hashed features grow with the number of distinct training words (`Shape`).

Counts cover all training documents. A word's probability within a class of frequent words has one
feature, the token before, and is its counts', smoothed. Class weights start from each feature's own counts
and are mended in rounds of distributed gradient updates: tasks sum what the features of their
documents observe and what the common weights expect, the sums are added up, and one step is made
from them. Sums do not depend on how documents are spread over tasks.

Documents are tokenised once, into a table of slices: distinct hashes and each token's place among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches, long_ids, written
from spectraloom.llm.words import groups, hash_words, mix64

#: Classes of frequent words at least, and as many words in each and classes of other words.
LEAST_SIDE = 32
#: And at most, which bounds what is broadcast: 160 MB of weights.
MOST_SIDE = 96
#: Contexts whose classes are weighed at once, and tokens that are grouped by context at once.
BATCH, GROUPED = 4096, 1_000_000
#: Tokens that a class's own share, and a word's within its class, weigh as much as where a feature's counts are smoothed.
CLASS_PRIOR, WORD_PRIOR = 100.0, 5.0
#: Features of a token overlap: what each says alone counts so much, and so much of a step is made.
SHARE, RATE, STEP_PRIOR = 0.4, 0.4, 150.0
#: Distinct words whose counts a task holds; tokens that a task sums over at least, in units of the model's numbers and in all.
HELD_WORDS, TASK_SHARE, TASK_TOKENS = 2_000_000, 4, 8_000_000
#: Rows of a table that travel together, and pairs of a slice and a rare word that are looked up together.
BLOCK, LOOKED_UP = 512, 1 << 20
#: Words that make up at least this share of the corpus go to every task: so many at most.
FREQUENT = 1 << 18
#: Stands for the end of a text among the words' hashes. No word has white space.
END = int(mix64(np.array([0x5EED], np.uint64))[0])
ENDINGS = 1 << 16
#: Bits of a hash that the table of frequent words is entered by.
LOOKUP = 18
_EDGE = np.zeros(256, bool)
_EDGE[[0, 32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: `side` classes of `side` frequent words, and `side` classes of other words."""

    side: int

    @staticmethod
    def of(types: int) -> Shape:
        """About as many frequent words as the square root of the distinct ones, up to MOST_SIDE squared."""
        return Shape(min(MOST_SIDE, max(LEAST_SIDE, math.ceil(types**0.25 / 8) * 8)))

    @property
    def head(self) -> int:
        return self.side * self.side

    @property
    def classes(self) -> int:
        return 2 * self.side

    @property
    def kinds(self) -> int:
        """What a context position may hold: a frequent word, a tail class, or the text's beginning (the last)."""
        return self.head + self.side + 1

    @property
    def pairs(self) -> int:
        return 8 * self.head

    @property
    def rows(self) -> int:
        """Of the class table: three positions before, hashed pairs, and the bias."""
        return 3 * self.kinds + self.pairs + 1

    @property
    def befores(self) -> int:
        """Rows of the word table for each class: one for each token before, hashed where these are too many for a task's memory."""
        return min(self.kinds, (1 << 17) // self.side + 8 * self.side)

    @property
    def word_rows(self) -> int:
        return self.side * self.befores

    def named(self, kinds: np.ndarray) -> np.ndarray:
        """The class of each token."""
        return np.where(kinds < self.head, kinds // self.side, kinds - self.head + self.side)


def in_training(id_col: str, modulus: int = 7, fold: int = 2) -> Column:
    """False for the held-out fold; ids that are null are in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus != fold, F.lit(True))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of its ending, tokens of each text); every text closes with END.

    An ending is a word's last three bytes, or all of fewer.
    """
    hashed, at = hash_words(texts)
    data = np.frombuffer(b"\0\0\0" + b" ".join(texts) + b" ", np.uint8)
    blank = _EDGE[data[3:]] & (data[3:] != 0)
    stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 4 if len(data) > 4 else np.zeros(0, np.int64)
    if len(stops) != len(hashed):
        raise AssertionError("words and their ends differ in number")
    tail = np.zeros(len(hashed), np.uint64)
    whole = np.ones(len(hashed), bool)
    for back in (1, 2, 3):
        byte = data[stops - back]
        whole &= ~_EDGE[byte]
        tail = tail * np.uint64(256) + np.where(whole, byte, 0).astype(np.uint64)
    ending = (mix64(tail) & np.uint64(ENDINGS - 1)).astype(np.int64)
    counts = np.bincount(at, minlength=len(texts)) + 1
    ends = np.cumsum(counts) - 1
    tokens = np.empty(len(hashed) + len(texts), np.uint64)
    endings = np.zeros(len(tokens), np.int64)
    word = np.ones(len(tokens), bool)
    word[ends] = False
    tokens[word], tokens[ends], endings[word] = hashed, END, ending
    return tokens, endings, counts


@dataclass
class Vocabulary:
    """What the counts say: at most FREQUENT words and ENDINGS endings, whatever the corpus."""

    shape: Shape
    total: int  # training tokens
    types: int  # distinct training tokens
    words: np.ndarray  # hashes of frequent words, sorted
    first: np.ndarray  # where the words of each prefix begin; the last entry is their number
    counts: np.ndarray
    head: np.ndarray  # their place among the most frequent, or -1
    tail_class: np.ndarray  # of each hashed ending
    tail_log: np.ndarray  # log10 of a tail class's tokens + types + 1
    class_logits: np.ndarray
    word_logits: np.ndarray

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the frequent words, whether it is one) of each token."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        bucket = (tokens >> np.uint64(64 - LOOKUP)).astype(np.int64)
        at = np.minimum(self.first[bucket], len(self.words) - 1)  # buckets after the last word are empty
        known = self.words[at] == tokens
        # A bucket holds few words; what its first is not steps on inside it.
        left = np.flatnonzero(~known)
        step = 1
        while len(left := left[self.first[bucket[left]] + step < self.first[bucket[left] + 1]]):
            found = self.words[self.first[bucket[left]] + step] == tokens[left]
            at[left[found]] += step
            known[left[found]] = True
            left, step = left[~found], step + 1
        return at, known

    def kinds(self, tokens: np.ndarray, endings: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        head = np.where(known, self.head[at] if len(self.head) else -1, -1)
        return np.where(head >= 0, head, self.shape.head + self.tail_class[endings])


@dataclass
class Slice:
    """About a megabyte of texts as tokens. words: distinct hashes in ascending order; places: of each token among them."""

    held: np.ndarray
    turn: np.ndarray
    n: np.ndarray  # tokens of each text
    words: np.ndarray
    endings: np.ndarray  # of each distinct word
    places: np.ndarray

    @staticmethod
    def rows(batch) -> Iterator[Slice]:
        held, turn = batch.column("held").to_pylist(), batch.column("turn").to_pylist()
        packed = [batch.column(c).to_pylist() for c in ("n", "words", "endings", "places")]
        for i in range(batch.num_rows):
            n, words, endings, places = (x[i] for x in packed)
            words = np.frombuffer(words, np.uint64)
            wide = np.uint16 if len(words) <= 1 << 16 else np.uint32
            yield Slice(np.array(held[i], bool), np.array(turn[i], np.int64), np.frombuffer(n, np.uint32).astype(np.int64), words, np.frombuffer(endings, np.uint16).astype(np.int64), np.frombuffer(places, wide))

    def kinds(self, vocabulary: Vocabulary) -> np.ndarray:
        return vocabulary.kinds(self.words, self.endings, *vocabulary.find(self.words))[self.places]


_SLICES = "slice long, ids array<long>, held array<boolean>, turn array<int>, n binary, words binary, endings binary, places binary"


def tokenise(docs: DataFrame, rounds: int) -> DataFrame:
    """The table of slices of (doc_id, text), written once; turn is the round a document's gradients belong to."""
    import pyarrow as pa

    names = [x.split()[0] for x in _SLICES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column(3).to_pylist()]
            made: list[tuple] = []
            for a, b in groups(texts):
                tokens, endings, n = tokens_of(texts[a:b])
                order = np.argsort(tokens)
                new = np.concatenate([[True], (ranked := tokens[order])[1:] != ranked[:-1]])
                distinct, first, places = ranked[new], order[new], np.empty(len(tokens), np.int64)
                places[order] = np.cumsum(new) - 1
                wide = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
                part = batch.slice(a, b - a)
                made.append((number, *(part.column(i).to_pylist() for i in range(3)), *(x.tobytes() for x in (n.astype(np.uint32), distinct, endings[first].astype(np.uint16), places.astype(wide)))))
                number += 1
            if made:
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types, strict=True)], names)

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int")
    marked = docs.select("doc_id", (~in_training("doc_id")).alias("held"), turn.alias("turn"), "text")
    return written(marked.mapInArrow(run, _SLICES), "slices", "zstd")


def count_tokens(slices: DataFrame) -> DataFrame:
    """(h, c, e): hash, count and ending of every distinct token of the training documents."""
    import pyarrow as pa

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        h, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.uint64)
        return np.stack([h, c, np.concatenate([p[2] for p in parts])[first]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].astype(np.int64)), pa.array(rows[2].astype(np.int32))], ["h", "c", "e"])

        held: list[np.ndarray] = []
        for batch in batches:
            for s in Slice.rows(batch):
                c = np.bincount(s.places[np.repeat(~s.held, s.n)], minlength=len(s.words))
                own = np.flatnonzero(c)
                held.append(np.stack([s.words[own], c[own].astype(np.uint64), s.endings[own].astype(np.uint64)]))
                if sum(p.shape[1] for p in held) > HELD_WORDS:
                    held = [summed(held)]
                    if held[0].shape[1] > HELD_WORDS // 2:
                        yield made(held.pop())
        if held:
            yield made(summed(held))

    found = slices.select("held", "turn", "n", "words", "endings", "places").mapInArrow(run, "h long, c long, e int")
    return written(found.groupBy("h").agg(F.sum("c").alias("c"), F.min("e").alias("e")), "counts")


def make_vocabulary(counts: DataFrame) -> Vocabulary:
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shape = Shape.of(types)
    side = shape.side
    # A share of at least 1/FREQUENT: FREQUENT words can have that, no more.
    frequent = sorted((r.h & (1 << 64) - 1, r.c, r.e) for r in counts.where(F.col("c") * FREQUENT >= total).collect())
    words = np.array([r[0] for r in frequent], np.uint64)
    held = np.array([r[1] for r in frequent], np.int64)
    order = np.lexsort((words, -held))[: shape.head]
    head = np.full(len(words), -1, np.int64)
    head[order] = np.arange(len(order))
    tokens, kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy("e").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r.e], kinds[r.e] = r.c, r.n
    for i in order:  # what is left of each ending without the head
        tokens[frequent[i][2]] -= held[i]
        kinds[frequent[i][2]] -= 1
    own = side * 3 // 4
    tail_class = own + np.arange(ENDINGS) % (side - own)
    tail_class[np.argsort(-tokens, kind="stable")[:own]] = np.arange(own)
    tail_tokens = np.bincount(tail_class, tokens, side)
    tail_log = np.log10(tail_tokens + np.bincount(tail_class, kinds, side) + 1)
    shares = np.zeros(shape.head)
    shares[: len(order)] = held[order]
    shares = shares.reshape(side, side)
    by_class = np.concatenate([shares.sum(axis=1), tail_tokens])
    empty = np.concatenate([shares.sum(axis=1) == 0, np.zeros(side, bool)])
    word_logits = np.where(shares > 0, np.log(np.maximum(shares, 1)), -40.0)
    class_logits = np.where(empty, -40.0, np.log((by_class + 1) / (by_class.sum() + shape.classes)))
    prefixes = (words >> np.uint64(64 - LOOKUP)).astype(np.int64)
    first = np.searchsorted(prefixes, np.arange((1 << LOOKUP) + 1))
    return Vocabulary(shape, total, types, words, first, held, head, tail_class, tail_log, class_logits.astype(np.float32), word_logits.astype(np.float32))


@dataclass
class Weights:
    """classes: a row of class logits for each feature; words: of word logits for (class, token before)."""

    classes: np.ndarray
    words: np.ndarray

    @staticmethod
    def start(vocabulary: Vocabulary) -> Weights:
        shape = vocabulary.shape
        out = Weights(np.zeros((shape.rows, shape.classes), np.float32), np.zeros((shape.word_rows, shape.side), np.float32))
        out.classes[-1] = vocabulary.class_logits
        return out


def features(shape: Shape, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: the tokens one, two and three before, the pair before.

    The bias, the table's last row, is added to all.
    """
    n = len(kinds)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.empty((n, 4), np.int32)
    for back in (1, 2, 3):
        before = np.full(n, shape.kinds - 1, np.int32)
        before[back:] = kinds[:-back] if back < n else kinds[:0]
        before[place < back] = shape.kinds - 1
        out[:, back - 1] = (back - 1) * shape.kinds + before
    pair = mix64((out[:, 0].astype(np.int64) * shape.kinds + out[:, 1] + 1).astype(np.uint64))
    out[:, 3] = 3 * shape.kinds + (pair % np.uint64(shape.pairs)).astype(np.int64)
    return out


def _segment_sums(ranked: np.ndarray, cut: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at cut: long runs each on its own, short ones a row at a time side by side."""
    out = ranked[cut]
    for i in np.flatnonzero(lengths > 16).tolist():
        out[i] = np.einsum("ij->j", ranked[cut[i] : cut[i] + lengths[i]])
    left, step = np.flatnonzero((lengths > 1) & (lengths <= 16)), 1
    while len(left):
        out[left] += ranked[cut[left] + step]
        step += 1
        left = left[lengths[left] > step]
    return out


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return cut, np.diff(np.append(cut, len(ranked)))


class Contexts:
    """Tokens grouped by the three tokens before: what a model says of the next class is computed once for each group.

    Groups are in order of the two tokens before, so the features of these are added once for each such pair.
    """

    def __init__(self, shape: Shape, every: np.ndarray):
        kinds = np.int64(shape.kinds)
        before = [every[:, j].astype(np.int64) - j * kinds for j in range(3)]
        key = (before[0] * kinds + before[1]) * kinds + before[2]
        self.order = np.argsort(key)
        cut, self.n = _runs(key[self.order])
        self.rows = every[self.order[cut]]

    def batches(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, their rows, where pairs begin among them, how many each has)."""
        for a in range(0, len(self.rows), BATCH):
            rows = self.rows[a : a + BATCH]
            cut, lengths = _runs(rows[:, 0].astype(np.int64) << 32 | rows[:, 1])
            yield slice(a, a + len(rows)), rows, cut, lengths

    @staticmethod
    def logits(weights: Weights, rows: np.ndarray, cut: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        pairs = np.take(weights.classes, rows[cut, 0], axis=0)
        for j in (1, 3):
            pairs += np.take(weights.classes, rows[cut, j], axis=0)
        pairs += weights.classes[-1]
        x = np.repeat(pairs, lengths, axis=0)
        x += np.take(weights.classes, rows[:, 2], axis=0)
        return x


def _word_rows(shape: Shape, kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of frequent words: which tokens they are, their row of the word table, their place in the class."""
    at = np.flatnonzero(kinds < shape.head)
    group, place = np.divmod(kinds[at], shape.side)
    before = rows[at, 0]
    if shape.befores < shape.kinds:
        before = (mix64(before.astype(np.uint64)) % np.uint64(shape.befores)).astype(np.int64)
    return at, group * shape.befores + before, place


def word_logs(weights: Weights, vocabulary: Vocabulary) -> np.ndarray:
    """Natural logarithms of each word's probability in its class, by row of the word table."""
    x = weights.words + np.repeat(vocabulary.word_logits, vocabulary.shape.befores, axis=0)
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probabilities(weights: Weights, vocabulary: Vocabulary, kinds: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """log10 of each token's class and, for frequent words, of the word in it; else less the class's log size.

    words: what word_logs gives, for callers that have it.
    """
    shape = vocabulary.shape
    every, named = features(shape, kinds, counts), shape.named(kinds)
    out = np.empty(len(kinds))
    for lo in range(0, len(kinds), GROUPED):
        contexts = Contexts(shape, every[lo : lo + GROUPED])
        ends = np.concatenate([[0], np.cumsum(contexts.n)])
        for own, rows, cut, lengths in contexts.batches():
            x = Contexts.logits(weights, rows, cut, lengths)
            top = x.max(axis=1)
            group = np.repeat(np.arange(len(rows)), contexts.n[own])
            token = contexts.order[ends[own.start] : ends[own.stop]] + lo
            value = x[group, named[token]]
            x -= top[:, None]
            np.exp(x, out=x)
            out[token] = value - (top + np.log(np.einsum("ij->i", x)))[group]
    at, where, place = _word_rows(shape, kinds, every)
    out[at] += (word_logs(weights, vocabulary) if words is None else words)[where, place]
    out = np.maximum(out / math.log(10), -60.0)
    tail = kinds >= shape.head
    out[tail] -= vocabulary.tail_log[kinds[tail] - shape.head]
    return out


class Sums:
    """A task's sums over the tokens it has seen: tables that are added up over tasks.

    Of the first pass (no weights): how often each feature's tokens are of each class, and each (class,
    token before) of each word. Of a round: the same of classes, and what the weights expect.
    """

    def __init__(self, vocabulary: Vocabulary, weights: Weights | None = None):
        shape = vocabulary.shape
        self.shape, self.weights = shape, weights
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = (shape.rows, shape.classes)
        self.tables = [np.zeros(size, np.uint32), np.zeros((shape.word_rows, shape.side), np.uint32) if weights is None else np.zeros(size, np.float32)]

    def add(self, kinds: np.ndarray, counts: np.ndarray) -> None:
        """Tokens of whole texts; they count once `settle` was called."""
        self.waiting.append((kinds, counts))
        if sum(len(k) for k, _ in self.waiting) >= GROUPED:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        kinds, counts = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        shape, observed = self.shape, self.tables[0]
        every, named = features(shape, kinds, counts), shape.named(kinds)
        for j in range(4):
            np.add.at(observed.reshape(-1), every[:, j].astype(np.int64) * shape.classes + named, np.uint32(1))
        observed[-1] += np.bincount(named, minlength=shape.classes).astype(np.uint32)
        if self.weights is None:
            _, where, place = _word_rows(shape, kinds, every)
            np.add.at(self.tables[1].reshape(-1), where * shape.side + place, np.uint32(1))
            return
        expected = self.tables[1]
        contexts = Contexts(shape, every)
        for own, rows, cut, lengths in contexts.batches():
            p = Contexts.logits(self.weights, rows, cut, lengths)
            if not p.max() < 60:  # far from what training reaches
                p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= (contexts.n[own] / np.einsum("ij->i", p))[:, None].astype(np.float32)
            pairs = _segment_sums(p, cut, lengths)
            expected[-1] += np.einsum("ij->j", pairs)
            for j, of, at in ((0, pairs, rows[cut, 0]), (1, pairs, rows[cut, 1]), (3, pairs, rows[cut, 3]), (2, p, rows[:, 2])):
                # Sixteen bits are sorted by radix; larger tables need more.
                order = np.argsort(at.astype(np.uint16 if shape.rows <= 1 << 16 else np.int32), kind="stable")
                ranked = at[order]
                begin, n = _runs(ranked)
                expected[ranked[begin]] += _segment_sums(np.take(of, order, axis=0), begin, n)


def start_weights(vocabulary: Vocabulary, observed: np.ndarray, words: np.ndarray) -> Weights:
    """From the counts of the whole training corpus: a share of what each feature says alone of classes; a word's smoothed probability."""
    out = Weights.start(vocabulary)
    shape = vocabulary.shape
    share = (observed[-1] + 1.0) / (observed[-1].sum() + shape.classes)
    n = observed.sum(axis=1, keepdims=True, dtype=np.float64)
    out.classes[:] = SHARE * np.log((observed + CLASS_PRIOR * share) / ((n + CLASS_PRIOR) * share))
    out.classes[-1] = vocabulary.class_logits
    own = np.exp(vocabulary.word_logits.astype(np.float64))
    own /= own.sum(axis=1, keepdims=True)
    own = np.repeat(own, shape.befores, axis=0)
    n = words.sum(axis=1, keepdims=True, dtype=np.float64)
    out.words[:] = np.log((words + WORD_PRIOR * own) / ((n + WORD_PRIOR) * np.maximum(own, 1e-12)))
    return out


def stepped(weights: Weights, observed: np.ndarray, expected: np.ndarray, rate: float) -> Weights:
    """Weights after a step along the gradient, observed less expected counts, on the scale of their logarithms."""
    total = observed[-1].sum()
    if not total:
        return weights
    prior = STEP_PRIOR * (observed[-1] + 1.0) / (total + len(observed[-1]))
    change = rate * np.log((observed + prior) / (expected + prior))
    change[-1] = 0.5 * np.log((observed[-1] + 1.0) / (expected[-1] + 1.0))
    return Weights((weights.classes + change).astype(np.float32), weights.words)


def summed_tables(slices: DataFrame, vocabulary: Broadcast, turn: int | None = None, weights: Weights | None = None) -> list[np.ndarray]:
    """Sums.tables over all training documents, or those of a round.

    What tasks send on grows with the tables: a task sums TASK_SHARE times as many tokens as these have
    numbers, and sends rows it touched. The driver gets one table of each, whose size the model bounds.
    """
    import pyarrow as pa

    spark = slices.sparkSession
    start = spark.sparkContext.broadcast(weights)
    shape, total = vocabulary.value.shape, vocabulary.value.total
    per_task = max(TASK_TOKENS, TASK_SHARE * shape.rows * shape.classes)
    names = ["which", "block", "rows", "numbers"]

    def sent(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for which, table in enumerate(tables):
            touched = np.flatnonzero(table.any(axis=1))
            cuts = np.flatnonzero(np.diff(touched // BLOCK, prepend=-1))
            for own in np.split(touched, cuts[1:]) if len(touched) else []:
                row = [[which], [int(own[0]) // BLOCK], [own.astype(np.uint32).tobytes()], [table[own].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def taken(batches: Iterable[pa.RecordBatch], add) -> None:
        for batch in batches:
            for which, rows, numbers in zip(*(batch.column(c).to_pylist() for c in ("which", "rows", "numbers")), strict=True):
                own = np.frombuffer(rows, np.uint32)
                add(which, own, numbers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        sums = Sums(known, start.value)
        for batch in batches:
            for s in Slice.rows(batch):
                own = ~s.held if turn is None else ~s.held & (s.turn == turn)
                if own.any():
                    sums.add(s.kinds(known)[np.repeat(own, s.n)], s.n[own])
        sums.settle()
        yield from sent(sums.tables)

    kinds = [np.dtype(np.uint32), np.dtype(np.uint32 if weights is None else np.float32)]
    wide = (shape.classes, shape.side if weights is None else shape.classes)

    def total_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of blocks; a task holds its own blocks of the tables."""
        held: dict[tuple[int, int], np.ndarray] = {}

        def add(which: int, own: np.ndarray, numbers: bytes) -> None:
            block = held.setdefault((which, int(own[0]) // BLOCK), np.zeros((BLOCK, wide[which]), np.float64))
            block[own % BLOCK] += np.frombuffer(numbers, kinds[which]).reshape(len(own), -1)

        taken(batches, add)
        for (which, at), block in held.items():
            own = np.flatnonzero(block.any(axis=1))
            row = [[which], [at], [(own + at * BLOCK).astype(np.uint32).tobytes()], [block[own].astype(np.float32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    schema = "which int, block int, rows binary, numbers binary"
    parts = slices.select("held", "turn", "n", "words", "endings", "places").coalesce(max(2, -(-total // per_task))).mapInArrow(run, schema)
    made = parts.repartition("which", "block").mapInArrow(total_of, schema).toArrow()
    out = [np.zeros((shape.rows, shape.classes)), np.zeros((shape.word_rows if weights is None else shape.rows, wide[1]))]

    def put(which: int, own: np.ndarray, numbers: bytes) -> None:
        out[which][own] = np.frombuffer(numbers, np.float32).reshape(len(own), -1)

    taken(made.to_batches(), put)
    start.unpersist()
    return out


@dataclass
class Model:
    """A vocabulary, its counts (a table) and the weights learnt."""

    vocabulary: Vocabulary
    counts: DataFrame
    weights: Weights


def train(slices: DataFrame, rounds: int, rate: float = RATE) -> Model:
    spark = slices.sparkSession
    counts = count_tokens(slices)
    vocabulary = spark.sparkContext.broadcast(make_vocabulary(counts))
    weights = start_weights(vocabulary.value, *summed_tables(slices, vocabulary))
    for r in range(rounds):
        weights = stepped(weights, *summed_tables(slices, vocabulary, r, weights), rate)
    return Model(vocabulary.value, counts, weights)


_ASKED = "bucket int, salt int, slice long, words binary, m binary, texts binary, tf binary"


def _rare_pairs(slices: DataFrame, vocabulary: Broadcast, buckets: int, salts: int) -> DataFrame:
    """Rows of a slice's words that are not frequent, dealt into buckets by hash; each word with the texts that hold it."""
    import pyarrow as pa

    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _ASKED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = vocabulary.value
        for batch in batches:
            for number, s in zip(batch.column("slice").to_pylist(), Slice.rows(batch), strict=True):
                _, known = known_words.find(s.words)
                rare = np.flatnonzero(~known)
                deal = (s.words[rare] >> np.uint64(20)).astype(np.int64) % buckets
                rank = np.full(len(s.words), -1, np.int64)  # of rare words, by bucket
                order = np.argsort(deal, kind="stable")
                rank[rare[order]] = np.arange(len(rare))
                at = rank[s.places]
                held = np.flatnonzero(at >= 0)
                text = np.repeat(np.arange(len(s.n)), s.n)[held]
                pair, tf = np.unique(at[held] * len(s.n) + text, return_counts=True)
                m = np.bincount(pair // len(s.n), minlength=len(rare))
                ends = np.concatenate([[0], np.cumsum(m)])
                cuts = np.searchsorted(deal[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    lo, hi = cuts[b], cuts[b + 1]
                    own = slice(ends[lo], ends[hi])
                    packed = (s.words[rare[order[lo:hi]]], m[lo:hi].astype(np.uint32), (pair[own] % len(s.n)).astype(np.uint32), tf[own].astype(np.uint32))
                    rows.append((b, number % salts, number, *(x.tobytes() for x in packed)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names)

    return slices.select("slice", "held", "turn", "n", "words", "endings", "places").mapInArrow(run, _ASKED)


def _rare_sums(slices: DataFrame, vocabulary: Broadcast, counts: DataFrame) -> DataFrame:
    """(slice, at, known, more): what words that are not frequent add to each text.

    Buckets hold LOOKED_UP pairs of a slice and a word on average, whatever the corpus. A word that is not
    frequent is at most in total / FREQUENT texts; more of these than a bucket should hold are salted.
    """
    import pyarrow as pa

    total = vocabulary.value.total
    pairs = slices.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    buckets, salts = max(16, pairs // LOOKED_UP), 1 + total // (FREQUENT * LOOKED_UP)
    asked = _rare_pairs(slices, vocabulary, buckets, salts)
    bucket = (F.shiftrightunsigned("h", 20) % buckets).cast("int").alias("bucket")
    salt = F.explode(F.sequence(F.lit(0).cast("int"), F.lit(salts - 1).cast("int"))).alias("salt")
    rare = counts.where(F.col("c") * FREQUENT < total).select(bucket, salt, "h", "c")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = np.append(h[order], np.uint64(0)), np.append(right.column("c").to_numpy()[order], 0)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for number, words, m, texts, tf in zip(*(left.column(x).to_pylist() for x in ("slice", "words", "m", "texts", "tf")), strict=True):
            words = np.frombuffer(words, np.uint64)
            at = np.searchsorted(h[:-1], words)
            held = np.repeat(np.where(h[at] == words, c[at], 0), np.frombuffer(m, np.uint32))
            texts, tf = np.frombuffer(texts, np.uint32), np.frombuffer(tf, np.uint32)
            n = int(texts.max()) + 1
            known, more = np.bincount(texts, tf * (held > 0), n), np.bincount(texts, tf * np.log10(held + 1.0), n)
            own = np.flatnonzero(known)
            for x, y in zip(out, (np.full(len(own), number), own, known[own].astype(np.int64), more[own]), strict=True):
                x.append(y)
        made = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["slice", "at", "known", "more"])

    return asked.groupBy("bucket", "salt").cogroup(rare.groupBy("bucket", "salt")).applyInArrow(run, "slice long, at long, known long, more double")


_SCORED = "slice long, at long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = RATE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Counts and the start of the weights come from all training documents. Round r's gradients
    come from those whose hashed id and text fall to it, so all are used once. Scores do not depend on
    partitions, but for the rounding of sums. Counts of words that are not frequent are looked up by hash.

    Null texts are empty (one end token). Every row has a result; rows of the same id and text are
    scored alike; a null id is in training. Ids must be integral. Without training documents
    every token is unknown. Other columns are not read. An empty table gives an empty one.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    slices = tokenise(docs.select(long_ids(docs, id_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), rounds)
    learnt = train(slices, rounds, rate)
    total, types = learnt.vocabulary.total, learnt.vocabulary.types
    vocabulary, model = (spark.sparkContext.broadcast(x) for x in (learnt.vocabulary, learnt.weights))
    scale = float(np.log10(total + types + 1))
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, weights = vocabulary.value, model.value
        logs, words = np.log10(known_words.counts + 1.0), word_logs(weights, known_words)
        for batch in batches:
            held = list(Slice.rows(batch))
            looked = [known_words.find(s.words) for s in held]
            kinds = [known_words.kinds(s.words, s.endings, *x)[s.places] for s, x in zip(held, looked, strict=True)]
            values = log_probabilities(weights, known_words, np.concatenate(kinds), np.concatenate([s.n for s in held]), words)
            values = np.split(values, np.cumsum([len(k) for k in kinds])[:-1])
            for number, ids, s, (found, known), own, value in zip(batch.column("slice").to_pylist(), batch.column("ids"), held, looked, kinds, values, strict=True):
                gain = np.where(known, logs[found] if len(logs) else 0.0, 0.0)[s.places]
                value += np.where(own >= known_words.shape.head, gain, 0.0)  # log10(c + 1); rare words' come later
                m = len(s.n)
                text = np.repeat(np.arange(m), s.n)
                known_n, base, score = (np.bincount(text, x, m) for x in (known[s.places], gain - scale, value))
                columns = [np.full(m, number), np.arange(m), ids.values, s.held, s.n, known_n.astype(np.int64), base, score]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    scored = slices.mapInArrow(run, _SCORED)
    rare = _rare_sums(slices, vocabulary, learnt.counts)
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens")]
    both = scored.unionByName(rare.select("slice", "at", *none, "known", F.col("more").alias("base"), F.col("more").alias("score")))
    rows = both.groupBy("slice", "at").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    return rows.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
