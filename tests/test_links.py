"""Addresses of links, and what pages lead to, against the standard library and a walk."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import graph
from spectraloom.sources import files

BASES = ["http://h.org/a/b/c.html?x=1#top", "https://h.org:8080/", "ftp://h.org", "https://h.org/data/"]
LINKS = ["d.mzML", "./d", "../d/", "../../../d", "/root/x?y=2", "//other.net/z", "https://full.org/q", "?k=v", "sub/dir/", "a/./b/../c", "..", ".", "d#frag", "mailto:someone", "../../data/./"]


def test_resolve_like_the_standard_library(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(rows, "base string, link string").select("base", "link", files.resolve(F.col("base"), F.col("link")).alias("to")).collect()
    strip = lambda u: u.split("#")[0]
    whole = lambda u: u + "/" if u.count("/") == 2 else u  # noqa: E731  a host alone is its root
    for r in got:
        assert whole(r.to) == whole(strip(urljoin(r.base, r.link))), (r.base, r.link)
    odd = spark.createDataFrame([("no base", "x"), (None, "x"), ("http://h.org/a", None)], "base string, link string")
    assert [r[0] for r in odd.select(files.resolve(F.col("base"), F.col("link"))).collect()] == [None] * 3


def test_folders(spark):
    urls = {"http://h.org/a/b?x/y#z/": "http://h.org/a", "http://h.org/a/": "http://h.org/a", "http://h.org/": "http://h.org", "http://h.org": "http://h.org"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", files.folder_of(F.col("u")).alias("f")).collect()
    assert {r.u: r.f for r in got} == urls


def test_reachable_like_a_walk(spark):
    edges = [(i, (i * 7 + k) % 60) for i in range(40) for k in (1, 5)] + [(3, 3), (3, 22), (3, 22), (None, 1), (2, None)]
    starts = [0, 3, 59, 200, 3, None]
    got = graph.reachable(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(s,) for s in starts], "start int")).collect()
    want = {}
    for s in {s for s in starts if s is not None}:
        depth, front = {s: 0}, [s]
        while front:
            front = sorted({b for a, b in edges if a in front and b is not None} - set(depth))
            depth |= dict.fromkeys(front, max(depth.values()) + 1)
        want |= {(s, n): d for n, d in depth.items()}
    assert {(r.start, r.node): r.depth for r in got} == want and len(got) == len(want)
    with pytest.raises(RuntimeError):
        graph.reachable(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(0,)], "start int"), rounds=1)


def test_components_of_long_chains(spark):
    """Sets are joined by all their members' neighbours: a chain in no order settles in few rounds."""
    draw = random.Random(4)
    ids = draw.sample(range(10000), 3000)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(2999) if i != 1499], "a long, b long")
    found = dict(map(tuple, graph.components(edges, "a", "b", rounds=9).collect()))
    assert found == dict.fromkeys(ids[:1500], min(ids[:1500])) | dict.fromkeys(ids[1500:], min(ids[1500:]))
