"""Points as array columns: powers, distances, sums, means.

A point may carry a weight: its coordinates are then sums over so many merged points.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def power(x: Column, n: int) -> Column:
    """x to the n-th power by products; 1 for n = 0."""
    if n < 0:
        raise ValueError("the exponent is below 0")
    out, square = None, x
    while n:
        if n & 1:
            out = square if out is None else out * square
        square, n = square * square, n >> 1
    return F.lit(1.0) if out is None else out


def distance(p: Column, q: Column, n: int = 2) -> Column:
    """The sum over dimensions of (p - q) ** n, in double precision; no root, no absolute value."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: power(a.cast("double") - b.cast("double"), n)), F.lit(0.0), lambda s, x: s + x)


def normalised(p: Column, weight: Column) -> Column:
    """The coordinates of the mean of a weighted point."""
    return F.transform(p, lambda x: x.cast("double") / weight)


def weighted_distance(p: Column, p_weight: Column, q: Column, q_weight: Column, n: int = 2) -> Column:
    """`distance` between the means of two weighted points."""
    return distance(normalised(p, p_weight), normalised(q, q_weight), n)


def added(p: Column, q: Column) -> Column:
    """p + q, by dimension."""
    return F.zip_with(p, q, lambda a, b: a + b)


def subtracted(p: Column, q: Column) -> Column:
    """p - q, by dimension."""
    return F.zip_with(p, q, lambda a, b: a - b)


def zeros(dim: int | Column) -> Column:
    """The origin."""
    return F.array_repeat(F.lit(0.0), dim)


def listed(xs: Column) -> Column:
    """An array as `[a,b,...]`."""
    return F.concat(F.lit("["), F.array_join(xs.cast("array<string>"), ","), F.lit("]"))


def all_ones(n: Column) -> Column:
    """The least 2**m - 1 that is not below n."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1)


def bucket_of(key: Column, n: int) -> Column:
    """One of n buckets by the key's hash."""
    return F.pmod(F.hash(key), F.lit(n))


def nearest(p: Column, centres: list[list[float]]) -> Column:
    """struct(dist, cluster_id) of the nearest centre, the lowest id on ties; the centres are literals, so nothing is joined."""
    every = [F.struct(distance(p, F.array(*[F.lit(float(x)) for x in c])).alias("dist"), F.lit(k).alias("cluster_id")) for k, c in enumerate(centres)]
    return reduce(lambda a, b: F.when(b["dist"] < a["dist"], b).otherwise(a), every)
