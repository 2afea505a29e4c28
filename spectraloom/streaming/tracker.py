"""Lines followed in a stream of scans, while the instrument still writes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spectraloom.operators.detect import Settings, Tracker

#: The lines that are alive, as they are kept between batches.
STATE = "mean array<double>, count array<long>, last array<long>, misses array<long>, name array<long>, lines long, now long"


def track(points: DataFrame, by: Sequence[str] = ("file_id",), s: Settings = Settings()) -> DataFrame:
    """(by, scan, mz, line) of a stream of (by, scan, mz): each point once, with its line's number within `by`.

    Lines are those that `detect.follow` finds on the whole, however scans are dealt to batches, if a
    scan comes in one batch and scans come in order. Points of a scan at or before the last one followed
    come too late: their line is null. So are those of points without a scan or an m/z. Between batches only the lines
    that are still alive are kept, a few rows for each value of `by`; with a null in it, rows are one more group.
    """
    keys = [points.schema[c] for c in by]
    out = T.StructType([*keys, T.StructField("scan", T.LongType()), T.StructField("mz", T.DoubleType()), T.StructField("line", T.LongType())])

    def batch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(s, *state.get) if state.exists else Tracker(s)
        rows = pd.concat(list(frames)).sort_values(["scan", "mz"], kind="stable").reset_index(drop=True)
        lines = pd.array([None] * len(rows), dtype="Int64")
        on_time = rows["scan"].notna() & rows["mz"].notna()
        if tracker.now is not None:
            on_time &= rows["scan"] > tracker.now
        for t, part in rows[on_time].groupby("scan", sort=True):
            lines[part.index.to_numpy()] = tracker.scan(int(t), part["mz"].to_numpy(float))
        if tracker.now is not None:
            held = (tracker.mean, tracker.count, tracker.last, tracker.misses, tracker.name)
            state.update((*[v.tolist() for v in held], tracker.lines, int(tracker.now)))
        yield rows.assign(line=lines)[[*by, "scan", "mz", "line"]]

    rows = points.selectExpr(*by, "cast(scan AS bigint) AS scan", "cast(mz AS double) AS mz")
    return rows.groupBy(*by).applyInPandasWithState(batch, out, STATE, "append", GroupStateTimeout.NoTimeout)
