"""Repeated windows against a plain walk: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import superkmers


def plain(rows, window):
    """(id, text) -> (words, removed, kept): windows are looked up in a dictionary of the earliest starts."""
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for s in range(len(words) - window + 1):
                if first[tuple(words[s : s + window])] != (i, s):
                    gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=60, kinds=30):
    """Few kinds of words, one passage in a third of the texts, copies, runs of one word."""
    draw = random.Random(seed)
    said = lambda k: " ".join(f"w{draw.randrange(kinds)}é" if draw.random() < 0.1 else f"w{draw.randrange(kinds)}" for _ in range(k))
    passage = said(40)
    rows = []
    for i in range(n):
        text = said(draw.randrange(0, 60))
        if i % 3 == 0:
            text = f"{text}\n{passage}\t {said(draw.randrange(9))}"
        if i % 7 == 0 and rows:
            text = rows[draw.randrange(len(rows))][1] or ""
        if i % 11 == 0:
            text = "same " * draw.randrange(200)
        rows.append((i * 3 % n, text))
    rows += [(None, passage), (1, None), (2, ""), (3, " \n\t "), rows[4], (rows[4][0], said(30) + passage), (7, said(3000) + " " + passage)]
    return rows


@pytest.mark.parametrize(("window", "gram", "held"), [(20, 4, superkmers.HELD_WORDS), (20, 4, 300), (5, 2, 60), (7, 7, 100), (1, 1, 50)])
def test_windows_like_plain_walk(spark, monkeypatch, window, gram, held):
    monkeypatch.setattr(superkmers, "BUCKET_WINDOWS", 200)
    monkeypatch.setattr(superkmers, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(superkmers, "HOT_WINDOWS", 40)
    monkeypatch.setattr(superkmers, "PIECE_BYTES", 500)
    rows = corpus(window * 100 + gram)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    frame = frame.select("doc_id", "text", F.lit(1).alias("id"), F.lit("x").alias("_runs"), F.lit(2).alias("n_words"), F.lit(3).alias("ROW"))
    got = superkmers.dedup_passages(frame, window=window, gram=gram, held=held)
    assert got.columns == ["doc_id", "text", "id", "_runs", "ROW", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=str) == plain(rows, window)


def test_nothing(spark):
    assert superkmers.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert superkmers.dedup_passages(spark.createDataFrame([(1, None), (None, None)], "doc_id int, text string")).count() == 2


def test_colliding_hashes_are_told_apart():
    """Windows are compared by their words: a hash that says little changes nothing."""
    draw = np.random.default_rng(1)
    numbers = draw.integers(0, 2, 3000)
    at = np.arange(len(numbers) - 6)
    starts, ids = at.copy(), np.zeros(len(at), np.int64)
    seen, want = set(), []
    for i in at:
        key = tuple(numbers[i : i + 7])
        want.append(key in seen)
        seen.add(key)
    for hashed in (None, np.zeros(len(at), np.uint64), (numbers[: len(at)] % 2).astype(np.uint64)):
        assert superkmers.later(numbers, at, ids, starts, 7, hashed).tolist() == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 20])
def test_hashes_and_minima_by_doubling(n):
    x = np.random.default_rng(n).integers(0, 5, 200).astype(np.uint64)
    grams = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    hashed = superkmers.gram_hashes(x, n)
    assert len(hashed) == len(grams) and len(set(zip(grams, hashed.tolist()))) == len(set(grams)) == len(set(hashed.tolist()))
    assert superkmers.sliding_least(x, n).tolist() == [min(g) for g in grams]
    assert len(superkmers.gram_hashes(x[: n - 1], n)) == 0
