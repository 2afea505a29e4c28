"""Matching of adjacent charges against a version that walks over one run."""

import random
from collections import defaultdict
from itertools import product

import pytest

from spectraloom.operators import charge_matching as C

PROTON = 1.007276554940804
SCHEMA = "file string, dist long, charge int, mean double, area double, start double, end double"


def drawn(seed, n=14):
    """Analytes at a few charges each, some twice at one, with lines missing at either end, and areas that seldom agree in order."""
    draw, rows, dist = random.Random(seed), [], 0
    for _ in range(n):
        mass, t, z0 = 1000 + draw.random() * 12, draw.random() * 3, draw.choice([1, 2, 3])
        shape = [draw.random() * 100 + 1 for _ in range(6)]
        for z in range(z0, z0 + draw.randrange(1, 4)):
            for _ in range(draw.choice([1, 1, 2])):
                first, last = draw.randrange(0, 2), draw.randrange(3, 6)
                for i in range(first, last):
                    a = t + draw.random() * 0.5
                    m = mass + i * PROTON + draw.gauss(0, 0.01)
                    rows.append((dist, z, m / z + PROTON, shape[i] * draw.choice([1, 1, 1, 0.4]) * (1 + draw.random() / 20), a, a + 1.5 + draw.random()))
                dist += 1
    return rows


def gathered(rows):
    out = defaultdict(lambda: [0, []])
    for d, z, mean, area, a, b in rows:
        out[d][0] = z
        out[d][1].append(((mean - PROTON) * z, area, a, b))
    return {d: (z, sorted(ms)) for d, (z, ms) in out.items()}


def nearest(a, b):
    return min((abs(x[0] - y[0]), i, j) for i, x in enumerate(a) for j, y in enumerate(b))


def met(a, b):
    inside = (a[2] > b[2] and a[3] < b[3]) or (b[2] > a[2] and b[3] < a[3])
    return inside or (min(a[3], b[3]) - max(a[2], b[2])) / (max(a[3], b[3]) - min(a[2], b[2])) > 0.5


def places(ms):
    return sorted(range(len(ms)), key=lambda i: (-ms[i][1], -i))


def plain_matches(ds):
    off = defaultdict(list)
    for z, ms in ds.values():
        off[z] += [abs(PROTON - (y[0] - x[0])) for x, y in zip(ms, ms[1:])]
    tol = {z: sum(v) / len(v) for z, v in off.items() if v}
    out = set()
    for o, (z, a) in ds.items():
        for n, (y, b) in ds.items():
            if y != z + 1 or z not in tol or not any(abs(p[0] - q[0]) <= tol[z] for p in a for q in b):
                continue
            if not (min(p[2] for p in a) < max(q[3] for q in b) and max(p[3] for p in a) > min(q[2] for q in b)):
                continue
            _, i, j = nearest(b, a)
            faced = [met(a[k], b[k + i - j]) for k in range(len(a)) if 0 <= k + i - j < len(b)]
            if sum(faced) * 2 <= len(faced):
                continue
            small, large = (a, b) if len(b) >= len(a) else (b, a)
            if sum(any(abs(p[0] - q[0]) < tol.get(y, -1) for q in large) for p in small) * 2 <= len(small):
                continue
            low = min(i, j)
            long = min(len(b) - i + low, len(a) - j + low)
            if sum(abs(p - q) for p, q in zip(places(a)[j - low :][:long], places(b)[i - low :][:long])) <= long - 1:
                out.add((o, n))
    return out


def plain_scores(ds, run):
    line_up = max((ds[d][1] for d in run), key=len)
    at = defaultdict(list)
    for k, d in enumerate(run):
        _, i, j = nearest(ds[d][1], line_up)
        for x, m in enumerate(ds[d][1]):
            at[x + j - i].append((k, m))
    at = {p: v for p, v in at.items() if len(v) > 1}
    if sum(max(m[2] for _, m in v) <= min(m[3] for _, m in v) for v in at.values()) * 2 <= len(at):
        return None
    off, share, overlap = [], defaultdict(list), []
    for v in at.values():
        mean, total = sum(m[0] for _, m in v) / len(v), sum(m[1] for _, m in v)
        off += [abs(mean - m[0]) for _, m in v]
        for k, m in v:
            share[k].append(m[1] / total)
        for x, (_, p) in enumerate(v):
            for _, q in v[x + 1 :]:
                overlap.append((min(p[3], q[3]) - max(p[2], q[2])) / (max(p[3], q[3]) - min(p[2], q[2])))
    overlap = [x for x in overlap if x > 0]
    uneven = [abs(sum(v) / len(v) - x) for v in share.values() for x in v]
    return (sum(uneven) / len(uneven), sum(off) / len(off), len(overlap) / sum(overlap)) if overlap else None


def plain_runs(ds, edges):
    label = {}
    for a, b in edges:
        old = {label.get(a, a), label.get(b, b)}
        label |= {a: min(old), b: min(old)} | {k: min(old) for k, v in label.items() if v in old}
    out = set()
    for g in set(label.values()):
        layers = defaultdict(list)
        for d in label:
            if label[d] == g:
                layers[ds[d][0]].append(d)
        zs = sorted(layers)
        for a in range(len(zs)):
            for b in range(a + 2, len(zs) + 1):
                out |= set(product(*(layers[z] for z in zs[a:b])))
    return out


def plain_analytes(ds):
    good = {r: s for r in plain_runs(ds, plain_matches(ds)) if (s := plain_scores(ds, r))}
    of = defaultdict(list)
    for r, s in good.items():
        for pair in zip(r, r[1:]):
            for d in pair:
                of[d].append((r, pair, s))
    ranks = {}
    for rows in of.values():
        sums = [sum(s[i] for _, _, s in rows) or 1 for i in range(3)]
        for r, pair, s in rows:
            v = (1, sum(s[i] / sums[i] for i in range(3))) if len(rows) > 1 else (2, s[0] + s[1])
            ranks[r, pair] = min(ranks.get((r, pair), (9, 0)), v)
    allowed, sets = {tuple(sorted(r)) for r in good}, {d: (d,) for d in ds}
    for (_, (o, n)), _ in sorted(ranks.items(), key=lambda x: (x[1], x[0][1])):
        a, b = sets[o], sets[n]
        both = tuple(sorted(a + b))
        if a != b and ((len(a) == len(b) == 1) or both in allowed):
            for d in both:
                sets[d] = both
    return {d: min(v) for d, v in sets.items()}


@pytest.fixture(scope="module")
def runs(spark):
    files = {f"f{i}": drawn(i) for i in range(4)}
    rows = [(f, *r) for f, rs in files.items() for r in rs] + [("f0", None, 2, 500.0, 1.0, 0.0, 1.0), ("f0", 990, 0, 500.0, 1.0, 0.0, 1.0)]
    return files, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_matches_and_runs(spark, runs):
    files, lines = runs
    dists = C.gathered(lines).cache()
    found = C.matches(dists).cache()
    every = C.runs(dists, found).cache()
    scores = {(r.file, tuple(r.run)): (r.intensity, r.mass, r.spread) for r in C.scored(dists, every).collect()}
    for f, rows in files.items():
        ds = gathered(rows)
        want = plain_matches(ds)
        assert {(r.o, r.n) for r in found.where(f"file = '{f}'").collect()} == want and want
        choices = plain_runs(ds, want)
        assert sorted(tuple(r.run) for r in every.where(f"file = '{f}'").collect()) == sorted(choices)
        known = {r: s for r in choices if (s := plain_scores(ds, r))}
        assert {r for g, r in scores if g == f} == set(known)
        assert all(scores[f, r] == pytest.approx(s) for r, s in known.items())


def test_analytes(spark, runs):
    files, lines = runs
    got = defaultdict(dict)
    for r in C.analytes(lines).collect():
        got[r.file][r.dist] = r.analyte
    for f, rows in files.items():
        assert got[f] == plain_analytes(gathered(rows))
    assert any(a != d for g in got.values() for d, a in g.items())


def test_no_lines(spark):
    assert C.analytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distributions_of_one_mass_at_other_times_do_not_meet(spark):
    """One mass at charges 2 and 3, again and again: candidates are as many as the times."""
    from spectraloom.operators.charge_matching import PROTON, alike, gathered, matches, tolerances

    rows = [("x", 2 * k + z - 2, z, (1000.0 + i * 1.003) / z + PROTON, 10.0 - i, 20.0 * k, 20.0 * k + 16) for k in range(120) for z in (2, 3) for i in range(3)]
    dists = gathered(spark.createDataFrame(rows, "file string, dist long, charge int, mean double, area double, start double, end double"))
    want = [(2 * k, 2 * k + 1) for k in range(120)]
    told = dists.join(tolerances(dists), ["file", "charge"])
    assert sorted((r["o"], r["n"]) for r in alike(told, 0.01).collect()) == want
    assert sorted((r["o"], r["n"]) for r in matches(dists).collect()) == want
