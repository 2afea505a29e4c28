"""The choice of isotope ranks against all combinations, and rankings that are written twice or lost half way."""

import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import rank_choice as R

SCHEMA = "scan long, line long, distribution long, analyte long, sequence string, charge int, ion string, rank int, expected_mz double, mz double, abundance double, intensity double, place long, score double"
N = len(R.ION)


def drawn(seed, ions=40):
    draw, rows = random.Random(seed), []
    for i in range(ions):
        scan, key = draw.randrange(6), (draw.randrange(2), draw.randrange(2), 1, draw.choice(["PEPTIDEK", "SAMPLER"]), draw.choice([1, 2]), draw.choice("by") + str(draw.randrange(1, 6)))
        top = draw.choice([1, 2, 4, 5])
        for rank in range(top):
            if rank == draw.choice([9, 9, 9, 2]):
                continue
            for _ in range(draw.choice([1, 1, 2, 3])):
                mz = 300 + i + rank + draw.gauss(0, 0.003)
                rows.append((scan, *key, rank, 300.0 + i + rank, mz, 0.6**rank, 1000 * (0.6 * draw.choice([0.55, 0.75, 0.85, 1.1])) ** rank * (0.8 + draw.random() * 0.2), draw.randrange(60), draw.random()))
    return rows


def deviation(seen, expected):
    off = lambda a, b: sum(abs(x - y) / y for x, y in zip(a, b))
    level = [x * sum(expected) / sum(seen) for x in seen]
    ratio = lambda v: [b / a for a, b in zip(v, v[1:])]
    return (off(level, expected) / len(seen) + off(ratio(level), ratio(expected)) / (len(seen) - 1)) / 2


def plain_choices(rows, averages):
    """Every combination of one peak a rank."""
    ions = defaultdict(lambda: defaultdict(list))
    for r in rows:
        ions[r[:N]][r[N]].append(r[N:])
    out = {}
    for key, ranks in ions.items():
        n = 0
        while n in ranks:
            n += 1
        found = []
        if n == 1:
            found = [(abs(averages[key[0]] - p[4]), (p,)) for p in ranks[0]]
        elif n > 1:
            for combo in product(*(ranks[k] for k in range(n))):
                fits = [a[3] / b[3] < a[4] / b[4] < (a[3] / b[3]) ** 2 for a, b in zip(combo, combo[1:])]
                m = fits.index(False) if False in fits else n - 1
                if m:
                    part = combo[: m + 1]
                    steps = [b[2] - a[2] for a, b in zip(part, part[1:])]
                    mean = sum(steps) / len(steps)
                    found.append((sum(abs(mean - x) for x in steps) / len(steps) * deviation([p[4] for p in part], [p[3] for p in part]), part))
        if found:
            out[key] = min(found)
    return out


@pytest.fixture(scope="module")
def chosen(spark):
    rows = drawn(1, 120)
    averages = {s: 300.0 + s for s in range(6)}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = R.choose(frame, spark.createDataFrame(list(averages.items()), "scan long, average double")).cache()
    return rows, averages, got


def test_choices_like_all_combinations(chosen):
    rows, averages, got = chosen
    want = plain_choices(rows, averages)
    mine = {tuple(r)[:N]: r for r in got.collect()}
    assert set(mine) == set(want)
    for key, (value, part) in want.items():
        assert mine[key].value == pytest.approx(value, abs=1e-12)
        if value > 1e-9:
            assert [tuple(p) for p in mine[key].peaks] == list(part)
        else:
            assert len(mine[key].peaks) == 2
    assert len({len(p) for _, p in want.values()}) > 2


def test_rankings(chosen):
    _, _, got = chosen
    plain, taken = defaultdict(list), set()
    best = sorted(got.collect(), key=lambda r: (r.value, r.ion, r.charge, r.line, r.distribution))
    first = {}
    for r in best:
        for p in r.peaks:
            first.setdefault((r.sequence, r.analyte, r.scan, p.place), (tuple(r)[:N], p.rank))
    for r in best:
        for p in r.peaks:
            if first[r.sequence, r.analyte, r.scan, p.place] != (tuple(r)[:N], p.rank):
                break
            taken.add((tuple(r)[:N], p.rank))
            plain[r.sequence, r.analyte, r.distribution, r.line, r.scan].append((r.ion, p))
    plain = {k: v for k, v in plain.items() if len({i for i, _ in v}) > 1}
    tables = R.rankings(got)
    scans = {(r.sequence, r.analyte, r.distribution, r.line, r.scan): r for r in tables["scan"].collect()}
    assert set(scans) == set(plain)
    for k, v in plain.items():
        assert scans[k].n_peaks == len(v) and scans[k].ions == sorted({i for i, _ in v}) and scans[k].intensity == pytest.approx(sum(p.intensity for _, p in v))
        assert scans[k].places == "/".join(map(str, sorted({p.place for _, p in v})))
    peptides = tables["peptide"].collect()
    for r in peptides:
        own = [x for k, v in plain.items() if k[:2] == (r.sequence, r.analyte) for x in v]
        assert r.n_peaks == len(own) and r.ion_score == pytest.approx(sum(p.score for _, p in own))
    assert sorted(r.place for r in peptides) == list(range(1, len(peptides) + 1))
    assert sum(r.n_peaks for r in tables["distribution"].collect()) == sum(len(v) for v in plain.values())


def test_rankings_are_added_whole_and_once(spark, tmp_path):
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    levels = lambda *xs: {"scan": table(*xs), "distribution": table(*xs[:1]), "peptide": table(*xs[:1])}
    R.write_rankings(levels(1, 2), str(tmp_path), "a")
    R.write_rankings(levels(3), str(tmp_path), "b")
    R.write_rankings(levels(1, 2), str(tmp_path), "a")
    # A run that was lost before its end has tables, but does not count.
    table(9).write.parquet(f"{tmp_path}/scan/run=c")
    read = lambda level: sorted((r.run, r.x) for r in R.read_rankings(spark, str(tmp_path), level).collect())
    assert read("scan") == [("a", 1), ("a", 2), ("b", 3)] and read("peptide") == [("a", 1), ("b", 3)]
    R.write_rankings(levels(9, 10), str(tmp_path), "c")
    R.write_rankings(levels(4), str(tmp_path), "a")
    assert read("scan") == [("a", 4), ("b", 3), ("c", 9), ("c", 10)]


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = R.choose(none, spark.createDataFrame([], "scan long, average double"))
    assert got.count() == 0 and all(t.count() == 0 for t in R.rankings(got).values())
