"""Shapes of isotope peaks against expected ones, orders that spread values, and how ions cut a sequence. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _off(a: Column, b: Column) -> Column:
    """Sum of the differences of two arrays as shares of the second's values."""
    return _sum(F.zip_with(a, b, lambda x, y: F.try_divide(F.abs(x - y), y)))


def shape_deviation(seen: Column, expected: Column) -> Column:
    """Mean of two deviations of an array from an expected one as long, after their sums are made equal.

    One is the mean difference of values, the other that of the ratios of neighbours, each as a share of the expected.
    Null for fewer than two values and where a sum, or a value that is divided by, is 0.
    """
    n = F.size(expected)
    level = F.transform(seen, lambda x: x * F.try_divide(_sum(expected), _sum(seen)))
    ratios = lambda xs: F.zip_with(F.slice(xs, 2, n), F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.try_divide(b, a))
    return F.when(n >= 2, (_off(level, expected) / n + F.try_divide(_off(ratios(level), ratios(expected)), n - 1)) / 2)


def spread(items: Column) -> Column:
    """An array of (value, other) in an order that sets unlike values side by side.

    The least and the greatest begin. The least or greatest of the rest joins the end from which it differs most;
    of equal gains the least goes before the greatest and the front before the back. Fewer than three are only sorted.
    """
    order = F.array_sort(items)
    n = F.size(items)
    start = F.struct(F.array(order[0], F.element_at(order, -1)).alias("s"), F.lit(2).alias("low"), (n - 1).alias("high"))

    def add(state: Column, _: Column) -> Column:
        s, least, most = state["s"], F.element_at(order, state["low"]), F.element_at(order, state["high"])
        front, back = F.element_at(s, 1), F.element_at(s, -1)
        gain = lambda x, end: F.abs(x["value"] - end["value"])
        a, b, c, d = gain(least, front), gain(least, back), gain(most, front), gain(most, back)
        low = F.greatest(a, b) >= F.greatest(c, d)
        ahead, behind = lambda x: F.concat(F.array(x), s), lambda x: F.concat(s, F.array(x))
        put = F.when(low & (a >= b), ahead(least)).when(low, behind(least)).when(c >= d, ahead(most)).otherwise(behind(most))
        return F.struct(put.alias("s"), (state["low"] + low.cast("int")).alias("low"), (state["high"] - (~low).cast("int")).alias("high"))

    return F.when(n < 3, order).otherwise(F.aggregate(F.sequence(F.lit(3), n), start, add)["s"])


def geometry(sequence: Column, ions: Column) -> Column:
    """(inverse_sum, sum_inverse, matches) of the fragment labels (`b3`, `y5`) found of a sequence.

    Labels cut it into pieces; a piece is covered by every label of the N-terminus that ends beyond its begin and
    every label of the C-terminus that begins at or before it. Three weights are summed, or their inverses:
    one over the number of covered pieces, the product over these of 1 / (their length times the sequence's), and
    one over the longest parts from both ends together. matches: distinct labels, and covered residues as often
    as they are covered. Null without labels.
    """
    n = F.length(sequence)
    counts = lambda kind: F.transform(F.filter(ions, lambda i: i.rlike(f"^[{kind}]")), lambda i: F.substr(i, F.lit(2)).cast("int"))
    ends, begins = counts("abc"), F.transform(counts("xyz"), lambda c: n - c)
    inner = F.array_sort(F.array_distinct(F.filter(F.concat(ends, begins), lambda c: (c > 0) & (c < n))))
    bounds = F.zip_with(F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(n)), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    over = lambda p: F.size(F.filter(ends, lambda e: e > p["a"])) + F.size(F.filter(begins, lambda b: b <= p["a"]))
    pieces = F.filter(F.transform(bounds, lambda p: F.struct(p["n"].alias("n"), over(p).alias("k"))), lambda p: p["k"] > 0)

    def told(p: Column) -> Column:
        lone = F.aggregate(p, F.lit(1.0), lambda s, x: s / (x["n"] * n))
        longest = F.coalesce(F.array_max(ends), F.lit(0)) + n - F.coalesce(F.array_min(begins), n)
        cuts, reach = F.try_divide(F.lit(1.0), F.size(p)), F.try_divide(F.lit(1.0), longest)
        matches = F.size(F.array_distinct(ions)) + F.aggregate(p, F.lit(0), lambda s, x: s + x["n"] * x["k"])
        return F.struct((1 / (cuts + lone + reach)).alias("inverse_sum"), (1 / cuts + 1 / lone + 1 / reach).alias("sum_inverse"), matches.alias("matches"))

    return F.when(F.size(pieces) > 0, F.get(F.transform(F.array(pieces), told), F.lit(0)))
