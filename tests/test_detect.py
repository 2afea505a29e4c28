import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spectraloom.functions import peaks
from spectraloom.operators import detect


def test_peaks_edges():
    find = lambda v, d=0: peaks.find_peaks(np.array(v, float), d).tolist()
    assert find([]) == [] and find([1, 1, 1]) == [[0, 0, 1]] and find([3]) == [[0, 0, 1]]
    assert find([1, 2, 3]) == [[0, 2, 3]] and find([3, 2, 1]) == [[0, 0, 3]]
    assert find([0, 5, 1, 4, 0]) == [[0, 1, 3], [2, 3, 5]]
    assert find([5, 1, 3, 1, 6], 2) == [[3, 4, 5]]
    assert find([0, 2, 2, 0]) == [[0, 1, 4]]


def test_centroids(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 4.0, 1.0, 6.0, 0.0]), (None, None), ([], [])], "m array<double>, i array<double>")
    rows = df.select(peaks.centroid_udf("sum")("m", "i").alias("c")).collect()
    assert np.allclose(rows[0].c.mz, [(8 + 3) / 5, (3 + 24) / 7]) and rows[0].c.intensity == [5.0, 7.0] and rows[2].c.mz == []
    got = spark.createDataFrame([([0.0, 5.0, 1.0, 4.0, 0.0],)], "v array<double>").select(peaks.peaks_udf()("v").alias("p")).first().p
    assert [tuple(x) for x in got] == [(0, 1, 3), (2, 3, 5)]


def cloud(seed, scans=60, n=12):
    """Random points of a few crowded traces."""
    rng = np.random.default_rng(seed)
    base = np.sort(rng.uniform(400, 400.3, n)).tolist() + [399.9995, 500.0]
    rows = [(1, t, t * 0.01, m + rng.normal(0, 0.0015), float(rng.uniform(1, 9))) for t in range(scans) for m in base if rng.random() < 0.6]
    return pd.DataFrame(rows, columns=["file_id", "scan", "rt", "mz", "intensity"])


def test_islands_follow_as_a_whole_file(spark):
    """Lines of islands, followed apart, are those of the whole file followed at once."""
    s = detect.Settings()
    for seed in (1, 2):
        data = cloud(seed).sort_values(["scan", "mz"]).reset_index(drop=True)
        frag = detect.follow(data["scan"].to_numpy(), data["mz"].to_numpy(), s)
        by = data.assign(f=frag).groupby("f").agg(a=("scan", "min"), b=("scan", "max"), m=("mz", "mean"), n=("mz", "size"))
        whole = detect.chain(*(by[c].to_numpy() for c in "abmn"), s)[frag]
        sets = lambda rows: {frozenset(g) for g in rows if len(g) >= s.least_points}
        want = sets([list(zip(g["scan"], g["mz"])) for _, g in data.groupby(whole)])
        got = detect.lines(spark.createDataFrame(data)).toPandas()
        assert got["island"].nunique() > 2
        assert sets([list(zip(g["scan"], g["mz"])) for _, g in got.groupby(["island", "line"])]) == want


def test_lines_survive_gaps_and_die():
    s = detect.Settings()
    go = lambda t: detect.follow(np.array(t), np.full(len(t), 500.0), s).tolist()
    assert go([0, 1, 5]) == [0, 0, 0] and go([0, 1, 6]) == [0, 0, 1] and go([0, 3, 7]) == [0, 0, 1]


def test_features_edges_analytes(spark):
    z, mass = 2, 1200.0
    rows = [(1, t, t * 0.02, mass / z + 1.00727655 + i * 1.00335 / z, a * float(np.exp(-((t - 20) ** 2) / 18))) for t in range(10, 31) for i, a in enumerate((1e5, 7e4, 3e4))]
    pts = spark.createDataFrame(rows, "file_id int, scan long, rt double, mz double, intensity double")
    lp = detect.lines(pts)
    table = detect.line_table(lp)
    feats = detect.features(detect.pieces(lp, table))
    got = feats.orderBy("mz_mean").collect()
    assert len(got) == 3 and all(r.n_points == 21 and r.ms1_apex == 20 for r in got)
    y = np.array([r[4] for r in rows if abs(r[3] - got[0].mz_mean) < 0.1])
    assert abs(got[0].area - np.trapezoid(y, dx=0.02)) < 1e-6
    edges = detect.isotope_edges(feats).collect()
    assert {(e.left_feature_id, e.right_feature_id, e.charge) for e in edges} >= {(got[0].feature_id, got[1].feature_id, 2), (got[1].feature_id, got[2].feature_id, 2)}
    d = spark.createDataFrame(
        [(1, 1, 2, 1200.0, 0.9, 0.9, 0.2, 0.4, 0.6), (1, 2, 3, 1200.005, 0.8, 0.8, 0.2, 0.41, 0.6), (1, 3, 3, 1200.004, 0.7, 0.7, 0.3, 0.5, 0.8), (1, 4, 2, 1300.0, 0.5, 0.5, 0.2, 0.4, 0.6)],
        "file_id int, distribution_id long, charge int, neutral_mass double, quality double, score double, rt_start double, rt_apex double, rt_end double",
    )
    members = detect.analytes(d)
    assert {(r.distribution_id, r.analyte_id) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {(r.analyte_id, r.charge_min, r.charge_max) for r in detect.analyte_table(d, members).collect()} == {(1, 2, 3), (3, 3, 3), (4, 2, 2)}


def test_long_lines_are_cut(spark):
    shape = [1, 5, 9, 5, 1, 5, 9, 5, 1]
    rows = [(1, 500.0, 0, t, t * 0.1, 500.0, float(y)) for t, y in enumerate(shape)] + [(1, 600.0 + k, 0, t, t * 0.1, 600.0 + k, 1.0) for k in range(9) for t in range(4)]
    lp = spark.createDataFrame(rows, "file_id int, island double, line long, scan long, rt double, mz double, intensity double")
    f = detect.features(detect.pieces(lp, detect.line_table(lp)))
    assert sorted((r.ms1_start, r.ms1_end) for r in f.where("island = 500").collect()) == [(0, 4), (4, 8)] and f.count() == 11


def test_trace_cosine(spark):
    t = spark.createDataFrame([(1, 1, 0, 3.0), (1, 1, 1, 4.0), (1, 2, 1, 2.0), (1, 3, 9, 1.0)], "file_id int, feature_id long, scan long, intensity double")
    p = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "file_id int, a long, b long")
    assert {(r.b, round(r.cosine, 6)) for r in detect.trace_cosine(p, t, "a", "b").collect()} == {(2, 0.8), (3, 0.0)}


def test_lines_do_not_depend_on_batches(spark):
    """Groups that end or go on with a batch, and one that fills several, keep their lines."""
    rng = np.random.default_rng(5)
    rows = [(f, int(t), t * 0.1, float(m + rng.normal(0, 0.0005)), 1.0) for f in (1, 2) for m in (400.1, 400.2, 401.5, 402.0, 900.3) for t in range(20) if rng.random() < 0.8]
    points = spark.createDataFrame(rows, "file_id int, scan long, rt double, mz double, intensity double")
    want = sorted(map(tuple, detect.lines(points).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for n in (1, 7, 33):
        spark.conf.set(name, str(n))
        assert sorted(map(tuple, detect.lines(points).collect())) == want
    spark.conf.set(name, before)
    assert len({(r[0], r[1], r[2]) for r in want}) == 10


def plain_split(t, y, s):
    """Peaks of a trace by the rules, one after another."""
    found = []
    for a, top, b in peaks.find_peaks(peaks.smooth(y, s.smooth), s.spacing):
        if b - a >= s.peak_points and y[top] >= s.peak_height and y[top] - max(y[a], y[b - 1]) >= y.max() * s.prominence:
            found.append((y[top], int(a), int(top), int(b)))
    if s.most_peaks:
        found = sorted(found, reverse=True)[: s.most_peaks]
    out = []
    for h, a, top, b in sorted(found, key=lambda p: p[1]):
        if out and s.valley > 0:
            g, c, peak, d = out[-1]
            lo, hi = sorted((peak, top))
            if y[lo : hi + 1].min() >= s.valley * min(g, h):
                out[-1] = (max(g, h), c, top if h >= g else peak, max(d, b))
                continue
        out.append((h, a, top, b))
    fits = lambda t, y: y.size >= s.peak_points and s.least_width <= t[-1] - t[0] <= s.peak_width and np.trapezoid(y, t) >= s.peak_area and y.max() >= s.peak_height
    return [p for p in out if fits(t[p[1] : p[3]], y[p[1] : p[3]])]


def test_split_traces_like_plain_rules(spark):
    rng = np.random.default_rng(8)
    traces = {i: (np.cumsum(rng.uniform(0.05, 0.3, n)), np.abs(np.convolve(rng.normal(0, 5, n), np.ones(int(w)), "same")) + 0.1) for i, (n, w) in enumerate(zip(rng.integers(8, 90, 25), rng.integers(1, 6, 25)))}
    rows = [(i, k, float(t), 400.0, float(y)) for i, (ts, ys) in traces.items() for k, (t, y) in enumerate(zip(ts, ys))]
    points = spark.createDataFrame(rows, "file_id int, scan long, rt double, mz double, intensity double").selectExpr("*", "1.0D AS island", "0L AS line")
    whole = points.select("file_id", "island", "line").distinct().withColumn("long", F.lit(True))
    joined = 0
    for s in (detect.Settings(), detect.Settings(valley=0.5, peak_points=3), detect.Settings(valley=0.8, peak_points=2, most_peaks=3, peak_height=4.0, peak_area=1.0, least_width=0.2, peak_width=3.0)):
        got = {}
        for r in detect.pieces(points.select("file_id", "island", "line", "scan", "rt", "mz", "intensity"), whole, s).groupBy("file_id", "piece").agg(F.min("scan").alias("a"), F.max("scan").alias("b")).collect():
            got.setdefault(r.file_id, []).append((r.a, r.b + 1))
        for i, (t, y) in traces.items():
            want = plain_split(t, y, s)
            joined += any(b - a > 1 for _, a, _, b in want) and s.valley > 0
            assert sorted(got.get(i, [])) == sorted((a, b) for _, a, _, b in want)
    assert joined


def test_scans_of_few_points_are_followed_fast():
    """Two lines over 100,000 scans, a point of each in a scan: what a scan costs beside its points is small."""
    import time

    n = 100_000
    scan, mz = np.repeat(np.arange(n), 2), np.tile([500.0, 500.5], n)
    began = time.process_time()
    got = detect.follow(scan, mz, detect.Settings())
    took = time.process_time() - began
    assert got.tolist() == [0, 1] * n
    assert took < 4, took  # it took 15.8 s when a scan's lines were arrays


def test_features_are_made_without_tables_between(spark, monkeypatch, tmp_path):
    """Of the points one table is written, that of the lines; pieces and traces are not, and features of the planted customers have their traces."""
    from spectraloom.plans import detection

    spark.range(70).select((F.col("id") + 1).alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    wrote, settled = [], detection.settled
    monkeypatch.setattr(detection, "settled", lambda rows, name: wrote.append(name) or settled(rows, name))
    got = detection.d07_features(spark, str(tmp_path))
    assert wrote == ["lines"] and got.count() == 5 * 105
    feats = detection._features(spark, str(tmp_path), True)
    assert feats.where(F.size("trace") != F.col("n_points")).count() == 0 and feats.count() == 5 * 105
