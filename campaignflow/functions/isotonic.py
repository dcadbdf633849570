"""Exact isotonic fit of a short array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col


def isotonic(values) -> Column:
    """Non-decreasing least-squares fit by the min-max formula; meant for grids of a few dozen points."""
    y = col(values)
    n = F.size(y)
    sums = F.aggregate(y, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def mean(i, j):
        return (sums[j] - sums[i - 1]) / (j - i + 1)

    return F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.array_max(F.transform(
            F.sequence(F.lit(1), k),
            lambda i: F.array_min(F.transform(F.sequence(k, n), lambda j: mean(i, j))))))


def interpolate(at, xs, ys) -> Column:
    """Linear interpolation on an increasing grid held in two arrays, flat beyond its ends."""
    at, xs, ys = col(at), col(xs), col(ys)
    below = F.size(F.filter(xs, lambda x: x <= at))
    inner = ys[below - 1] + (ys[below] - ys[below - 1]) * (at - xs[below - 1]) / (xs[below] - xs[below - 1])
    return F.when(below == 0, ys[0]).when(below >= F.size(xs), F.element_at(ys, -1)).otherwise(inner)
