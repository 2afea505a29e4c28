"""Lines of a stream equal those of the whole."""

import numpy as np
import pandas as pd
import pytest

from spectraloom.operators import detect
from spectraloom.streaming import tracker

SCHEMA = "file_id bigint, scan bigint, mz double"


def run(spark, tmp_path, batches):
    source = tmp_path / "in"
    source.mkdir()
    for i, b in enumerate(batches):
        b.to_parquet(source / f"{i:03d}.parquet", index=False)
        (source / f"{i:03d}.parquet").touch()
    points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"t{abs(hash(str(tmp_path)))}"
    q = tracker.track(points).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).toPandas()


def test_stream_equals_whole(spark, tmp_path):
    r = np.random.default_rng(5)
    base = np.array([400.0, 400.006, 500.0, 731.2])
    rows = [(f, t, m + r.normal(0, 0.0008)) for f in (1, 2) for t in range(24) for m in base if r.random() < 0.7 and not (m == 500.0 and 8 <= t < 16)]
    whole = pd.DataFrame(rows, columns=["file_id", "scan", "mz"]).sort_values(["scan", "mz"])
    got = run(spark, tmp_path, [whole[(whole.scan >= a) & (whole.scan < a + 6)] for a in range(0, 24, 6)])
    assert len(got) == len(whole)
    for f, part in whole.groupby("file_id"):
        part = part.sort_values(["scan", "mz"])
        want = detect.follow(part["scan"].to_numpy(), part["mz"].to_numpy(), detect.Settings())
        mine = got[got.file_id == f].sort_values(["scan", "mz"])
        assert mine["line"].astype(int).tolist() == want.tolist()
        assert len(set(want)) > 4  # one line ends and starts again


def test_late_and_null_points_keep_their_rows(spark, tmp_path):
    one = pd.DataFrame({"file_id": [1, 1], "scan": [5, 6], "mz": [400.0, 400.0]})
    two = pd.DataFrame({"file_id": [1, 1, 1], "scan": [6, 7, 8], "mz": [400.0, 400.0, np.nan]})
    got = run(spark, tmp_path, [one, two])
    assert sorted((s, -1 if pd.isna(line) else int(line)) for s, line in zip(got["scan"], got["line"])) == [(5, 0), (6, -1), (6, 0), (7, 0), (8, -1)]


@pytest.mark.parametrize("cut", [1, 3])
def test_a_tracker_resumes(cut):
    s = detect.Settings()
    scans = [(t, np.sort(np.array([300.0, 300.5]) + 0.0003 * t)) for t in (0, 1, 3, 8, 9)]
    whole = detect.Tracker(s)
    want = [whole.scan(t, x).tolist() for t, x in scans]
    first = detect.Tracker(s)
    got = [first.scan(t, x).tolist() for t, x in scans[:cut]]
    again = detect.Tracker(s, first.mean.tolist(), first.count.tolist(), first.last.tolist(), first.misses.tolist(), first.name.tolist(), first.lines, first.now)
    assert got + [again.scan(t, x).tolist() for t, x in scans[cut:]] == want
