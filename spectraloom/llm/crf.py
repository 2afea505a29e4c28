"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad; its own and its neighbours' features speak for one or the other,
transitions tie lines together. Forward-backward gives each line's chance of being good; the
average over lines, weighted by their lengths, is the document's, calibrated by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches, dropped, written
from spectraloom.llm.words import groups, hash_words

#: Classes of bytes whose share in a line is a feature.
_KINDS = ("upper", "lower", "digit", "blank", "stop", "bang", "bar", "sign", "high")
_KIND = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b".,;:'\"()-", b"!?", b"|")):
    _KIND[list(_set)] = _i
_KIND[[c for c in range(33, 128) if chr(c) not in ".,;:'\"()-!?|" and not chr(c).isalnum()]] = 7
_KIND[128:] = 8
_KIND[[c for c in range(32) if c not in (9, 11, 12, 13)]] = 7
OWN = len(_KINDS) + 5
#: A line's features, those of the line before and the line after, which may be absent.
WIDTH = 3 * OWN


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes plus one, lines of each text)."""
    lines, counts = [], []
    for t in texts:
        own = t.encode().split(b"\n")
        lines += own
        counts.append(len(own))
    n = len(lines)
    lengths = np.array([len(x) for x in lines], np.int64)
    out = np.zeros((n, OWN), np.float32)
    kinds = len(_KINDS)
    for a, b in groups(lines):
        data = np.frombuffer(b"".join(lines[a:b]), np.uint8)
        row = np.repeat(np.arange(b - a), lengths[a:b])
        share = np.bincount(row * kinds + _KIND[data], minlength=(b - a) * kinds).reshape(b - a, kinds)
        out[a:b, :kinds] = share / np.maximum(1, lengths[a:b])[:, None]
        words, at = hash_words(lines[a:b])
        number = np.bincount(at, minlength=b - a)[: b - a]
        again = np.bincount(at[1:][(words[1:] == words[:-1]) & (at[1:] == at[:-1])], minlength=b - a)[: b - a]
        later = np.bincount(at[2:][(words[2:] == words[:-2]) & (at[2:] == at[:-2])], minlength=b - a)[: b - a]
        out[a:b, kinds] = again / np.maximum(1, number)
        out[a:b, kinds + 1] = later / np.maximum(1, number)
        out[a:b, kinds + 2] = np.minimum(2.0, lengths[a:b] / np.maximum(1, number) / 10)
    out[:, kinds + 3] = np.log1p(lengths) / 10
    out[:, kinds + 4] = 1.0
    counts = np.array(counts, np.int64)
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:], after[:-1] = out[:-1], out[1:]
    before[first], after[first + counts - 1] = 0, 0
    return np.hstack([out, before, after]), lengths + 1, counts


@dataclass
class Crf:
    """weights: for good against bad; transitions[y, y']; curve: slope and offset of the calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def chains(self, features: np.ndarray, counts: np.ndarray):
        """Log forward and backward messages of every line, chains side by side, and log Z of each."""
        good = features @ self.weights
        emit = np.stack([np.zeros_like(good), good], axis=1)
        order = np.argsort(-counts, kind="stable")
        start = (np.cumsum(counts) - counts)[order]
        longest = counts[order]
        alive = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right")
        ahead, back, t = np.zeros_like(emit), np.zeros_like(emit), self.transitions
        ahead[start] = emit[start]
        for step in range(1, longest[0]):
            i = start[: alive[step]] + step
            p = ahead[i - 1]
            ahead[i] = np.logaddexp(p[:, :1] + t[0], p[:, 1:] + t[1]) + emit[i]
        for step in range(longest[0] - 1, 0, -1):
            i = start[: alive[step]] + step
            q = back[i] + emit[i]
            back[i - 1] = np.logaddexp(q[:, :1] + t[:, 0], q[:, 1:] + t[:, 1])
        ends = np.cumsum(counts) - 1
        return emit, ahead, back, np.logaddexp(ahead[ends, 0], ahead[ends, 1])

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        _, ahead, back, total = self.chains(features, counts)
        return np.exp(ahead[:, 1] + back[:, 1] - np.repeat(total, counts))

    def quality(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Marginals of good, averaged over a text's lines by length."""
        at = np.repeat(np.arange(len(counts)), counts)
        weighed = np.bincount(at, self.marginals(features, counts) * lengths, len(counts))
        return weighed / np.bincount(at, lengths, len(counts))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.quality(*line_features(texts))
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * _logit(raw) + b, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def gradient(params: np.ndarray, features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of some documents' labels, every line having its document's, and its slope; documents weigh alike."""
    model = Crf(params[:WIDTH], params[WIDTH:].reshape(2, 2))
    emit, ahead, back, total = model.chains(features, counts)
    line, weight, z = np.repeat(labels, counts), np.repeat(1.0 / counts, counts), np.repeat(total, counts)
    linked = np.ones(len(line), bool)
    linked[np.cumsum(counts) - counts] = False
    later = np.flatnonzero(linked)
    good = np.exp(ahead[:, 1] + back[:, 1] - z)
    pair = ahead[later - 1][:, :, None] + model.transitions + (emit[later] + back[later])[:, None, :] - z[later][:, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (line[later - 1], line[later]), weight[later])
    slope = np.concatenate([features.T @ (weight * (line - good)), (seen - (np.exp(pair) * weight[later][:, None, None]).sum(axis=0)).ravel()])
    own = (weight * emit[np.arange(len(line)), line]).sum() + (seen * model.transitions).sum()
    return float(own - (total / counts).sum()), slope


def ascend(evaluate, size: int, steps: int) -> np.ndarray:
    """Where a concave function is largest: limited-memory BFGS; evaluate gives its value and slope."""
    x = np.zeros(size)
    value, slope = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, held = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            held.append(a)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(held)):
            way += (a - (y @ way) / (s @ y)) * s
        pace = 1.0 if past else min(1.0, 1 / (np.abs(slope).sum() + 1e-12))
        for _ in range(12):  # half as far until it rises enough
            new = x + pace * way
            found, steep = evaluate(new)
            if found >= value + 1e-4 * pace * (slope @ way):
                break
            pace /= 2
        else:
            break
        s, y = new - x, slope - steep
        if s @ y > 1e-12:
            past = [*past, (s, y)][-8:]
        done = found - value < 1e-7 * (1 + abs(value))
        x, value, slope = new, found, steep
        if done:
            break
    return x


def calibrate(quality: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a document's quality to its chance of label 1."""
    x = _logit(quality)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly damped by a prior
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, g = p * (1 - p), labels - p
        h = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(g * x).sum() - 1e-2 * a, g.sum()])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


_FEATURES = "label int, n long, features binary, lengths binary"


def train(docs: DataFrame, labels: DataFrame, most_documents: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", steps: int = 40, decay: float = 1e-4) -> Crf:
    """A model of at most `most_documents` labelled documents, those of the least hashed ids.

    The bound is for labelled documents only: their whole texts count, lines of any number. Line
    features are a written table; each step's gradient is summed by tasks over their documents, one at
    a time, so that what the driver gets is bounded: sums, and at the end a number for each document. Labels
    other than 0 and 1 are left out; of several labels of an id the smallest holds; repeated rows of an id count
    each. Null texts have one empty line. Without both labels the scores are the labels' (smoothed) mean, 0.5 for none.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    plain = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = plain.orderBy(F.xxhash64("_id"), "_id").limit(most_documents)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "_id").select("_label", "text")

    def features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features, lengths, _ = line_features([text or ""])
                packed = ([label], [len(lengths)], [features.tobytes()], [lengths.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["label", "n", "features", "lengths"])

    table = written(rows.mapInArrow(features_of, _FEATURES), "features")
    counted = dict(table.groupBy("label").count().collect())
    lines = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number, ones = sum(counted.values()), counted.get(1, 0)
    model = Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    if len(counted) < 2:
        mean = (ones + 1) / (number + 2)
        model.curve = (0.0, float(np.log(mean / (1 - mean))))
        dropped(table)
        return model
    # A task takes some ten MB of features, so that short ones do not make up the time.
    spread = table.coalesce(max(1, lines * WIDTH * 4 // (16 << 20)))

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(features, lengths, counts, labels) of documents of some MB together; of a longer one alone."""
        held, size = [], 0

        def joined():
            features = np.frombuffer(b"".join(r[2] for r in held), np.float32).reshape(-1, WIDTH).astype(np.float64)
            return features, np.frombuffer(b"".join(r[3] for r in held), np.int64), np.array([r[1] for r in held]), np.array([r[0] for r in held])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and size + len(row[2]) > 4 << 20:
                    yield joined()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield joined()

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, slope = 0.0, np.zeros(WIDTH + 4)
            for features, _, counts, own in documents(batches):
                v, s = gradient(params, features, counts, own)
                value, slope = value + v, slope + s
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tolist()])], ["value", "slope"])

        parts = sorted(spread.mapInArrow(run, "value double, slope array<double>").collect())
        return sum(r.value for r in parts) / number - decay / 2 * params @ params, np.sum([r.slope for r in parts], axis=0) / number - decay * params

    params = ascend(evaluate, WIDTH + 4, steps)
    model.weights, model.transitions = params[:WIDTH], params[WIDTH:].reshape(2, 2)

    def qualities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for features, lengths, counts, own in documents(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.quality(features, lengths, counts)), pa.array(own)], ["quality", "label"])

    found = sorted(spread.mapInArrow(qualities, "quality double, label long").collect())
    model.curve = calibrate(np.array([r.quality for r in found]), np.array([r.label for r in found]))
    dropped(table)
    return model


def score_documents(docs: DataFrame, model: Crf, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The frame with a score (0 to 1) of each whole text; null and empty texts have one empty line.

    A column of the score's name gives way; others, of any name, stay as they are. Rows that are repeated or tie
    are scored alike. An empty table gives an empty one. No exchange.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    rest = [f for f in docs.schema.fields if f.name != score_col]
    names = [f.name for f in rest]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                scores = model.scores([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores, pa.float64())], [*names, score_col])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*rest, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str, modulus: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == fold, F.lit(False))
