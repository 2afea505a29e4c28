import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.functions import shapes


def test_shape_deviation(spark):
    rows = [(0, [2.0, 4.0, 1.0], [1.0, 2.0, 0.5]), (1, [1.0, 1.0], [1.0, 3.0]), (2, [1.0], [1.0]), (3, [0.0, 0.0], [1.0, 2.0]), (4, [1.0, 2.0], [0.0, 1.0])]
    got = [r.d for r in spark.createDataFrame(rows, "i int, s array<double>, e array<double>").orderBy("i").select(shapes.shape_deviation(F.col("s"), F.col("e")).alias("d")).collect()]
    # Of sum 4: 2 and 2 against 1 and 3 are off by 1 and 1/3; a ratio of 1 against 3 by 2/3.
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(((1 + 1 / 3) / 2 + 2 / 3) / 2) and got[2:] == [None, None, None]


def test_spread(spark):
    rng = np.random.default_rng(2)
    cases = [sorted((float(v), int(i)) for i, v in enumerate(rng.integers(0, 20, n))) for n in (0, 1, 2, 3, 6, 9, 14)]
    rows = spark.createDataFrame([(i, c[::-1]) for i, c in enumerate(cases)], "i int, x array<struct<value:double,other:int>>")
    got = [[tuple(p) for p in r.s] for r in rows.orderBy("i").select(shapes.spread(F.col("x")).alias("s")).collect()]
    for have, left in zip(got, cases):
        if len(left) < 3:
            assert have == left
            continue
        line, rest = [left[0], left[-1]], left[1:-1]
        while rest:
            ways = [(abs(rest[k][0] - line[e][0]), k, e) for k in (0, -1) for e in (0, -1)]
            _, k, e = max(ways, key=lambda w: w[0])  # the first of equal ones
            line.insert(0 if e == 0 else len(line), rest.pop(k))
        assert have == line


def test_geometry(spark):
    rows = [(0, "PEPTIDE", ["b2", "y3", "y3"]), (1, "PEPTIDE", []), (2, "PEPTIDE", ["b7"])]
    got = [r.g for r in spark.createDataFrame(rows, "i int, q string, x array<string>").orderBy("i").select(shapes.geometry(F.col("q"), F.col("x")).alias("g")).collect()]
    # PE|PT|IDE: PE by b2, IDE by y3 twice; PT by none.
    cuts, lone, reach = 1 / 2, 1 / (2 * 7) / (3 * 7), 1 / 5
    assert got[0].inverse_sum == pytest.approx(1 / (cuts + lone + reach)) and got[0].sum_inverse == pytest.approx(1 / cuts + 1 / lone + 1 / reach)
    assert got[0].matches == 2 + 2 + 3 * 2 and got[1] is None and got[2].matches == 1 + 7


def test_scalars_of_searches(spark):
    row = spark.createDataFrame([("", "12.5", "-1", "x", "3.5")], "a string, b string, c string, d string, e string").select(
        S.measured_mass(F.col("a"), F.col("b")).alias("mass"), S.measured_charge(F.col("c")).alias("z"), S.measured_time(F.col("d"), F.col("e")).alias("t"),
        S.levels(F.lit(" 3-4,1, ,2-3")).alias("levels"), S.mz_of(F.lit(998.0), F.lit(2)).alias("mz"), S.is_mzml(F.lit("A.mzML.GZ")).alias("m"), S.is_centroid_mzml(F.lit("a.mzML")).alias("c"),
    ).first()
    assert (row.mass, row.z, row.t, row.levels, row.m, row.c) == (12.5, None, 3.5, [1, 2, 3, 4], True, False) and row.mz == pytest.approx(499 + S.PROTON)
    q = spark.createDataFrame([(None,), (0.0,), (1e-4,), (0.05,), (1.0,)], "q double").select(S.q_position(F.col("q")).alias("t"), S.q_position(F.col("q"), True).alias("l")).collect()
    assert [r.t for r in q] == pytest.approx([0, 0, 0, 1, 1]) and [r.l for r in q] == pytest.approx([0, 2e-5, 2e-3, 1, 1])
    h = spark.range(1).select(S.heat(F.lit(0.0)).alias("a"), S.heat(F.lit(0.5)).alias("b"), S.heat(F.lit(1.0)).alias("c")).first()
    assert [tuple(x) for x in h] == [(0, 255, 40), (255, 255, 40), (255, 0, 40)]
    with pytest.raises(Exception, match="no levels"):
        spark.createDataFrame([(" , ",)], "t string").select(S.levels(F.col("t"))).collect()
