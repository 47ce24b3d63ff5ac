"""Optimal string alignment distance as a Column, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa_distance(a: Column, b: Column) -> Column:
    """Edits to turn ``a`` into ``b``; swapping neighbours costs one, and no
    substring is edited twice. A dynamic program over the characters of ``a``
    that keeps two rows."""
    m = F.length(b)
    first = F.sequence(F.lit(0), m)

    def one(c: Column) -> Column:
        return c.cast("int")

    def row(acc: Column, i: Column) -> Column:
        ca, before = F.substring(a, i, 1), F.when(i > 1, F.substring(a, i - 1, 1))

        def cell(done: Column, j: Column) -> Column:
            cb = F.substring(b, j, 1)
            cost = one(ca != cb)
            up, diag = F.get(acc["p1"], j), F.get(acc["p1"], j - 1)
            best = F.least(F.get(done, j - 1) + 1, up + 1, diag + cost)
            swap = (i > 1) & (j > 1) & (ca == F.substring(b, j - 1, 1)) & (before == cb)
            with_swap = F.when(swap, F.least(best, F.get(acc["p2"], j - 2) + 1)).otherwise(best)
            return F.concat(done, F.array(with_swap))

        cells = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.array(i), cell)).otherwise(F.array(i))
        return F.struct(acc["p1"].alias("p2"), cells.alias("p1"))

    start = F.struct(first.alias("p2"), first.alias("p1"))
    full = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), start, row, lambda acc: F.get(acc["p1"], m))
    return F.when(F.length(a) == 0, m).otherwise(full)


def similarity(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longest)


def close_distance(a: Column, b: Column, least: float) -> Column:
    """The distance where it allows similarity ``least``, else null.

    Guarded: an alignment of d edits has Levenshtein distance at most 2 d, so
    Spark's bounded Levenshtein rules out nearly all pairs first, and CASE
    keeps the costly expression from running for them.
    """
    longest = F.greatest(F.length(a), F.length(b))
    bound = F.floor((F.lit(1.0) - least) * longest + 1e-9).cast("int")
    near = (F.abs(F.length(a) - F.length(b)) <= bound) & (F.levenshtein(a, b) <= 2 * bound)
    return F.when(near, osa_distance(a, b))
