"""Two-dimensional grids: escape-time counts, colours, tile statistics."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bands of colours have this many counts; the square of the distance at which a point has escaped.
BAND, BOUND2 = 256, 1600.0


def pixels(spark: SparkSession, width: int, height: int, x: float, y: float, size_x: float, size_y: float) -> DataFrame:
    """`row, col, cx, cy`: every pixel and its place in the plane, by multiplication from the corner."""
    made = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return made.withColumn("cx", F.lit(float(x)) + F.col("col") * F.lit(float(size_x)) / width).withColumn("cy", F.lit(float(y)) + F.col("row") * F.lit(float(size_y)) / height)


def escape_counts(cx: np.ndarray, cy: np.ndarray, max_iter: int, escape2: float) -> np.ndarray:
    """How often z = z * z + c is applied from 0 while fewer than max_iter times and |z| squared is at most escape2."""
    count = np.zeros(len(cx), np.int32)
    at, re, im = np.arange(len(cx)), np.zeros(len(cx)), np.zeros(len(cx))
    for _ in range(max_iter):
        go = re * re + im * im <= escape2
        at, re, im = at[go], re[go], im[go]
        if not len(at):
            break
        x, y = cx[at], cy[at]
        re, im = (re * re - im * im) + x, (2 * re) * im + y
        count[at] += 1
    return count


def compute(grid: DataFrame, kind: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Adds `n`: any vectorised function of the plane coordinates, on Arrow batches."""

    @F.pandas_udf("int")
    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(kind(x.to_numpy(), y.to_numpy()))

    return grid.withColumn("n", value("cx", "cy"))


def escape_counts_of(cx: Column, cy: Column, max_iter: Column, escape2: Column) -> Column:
    """`escape_counts` as a column, with a bound on iterations that may differ from row to row."""

    @F.pandas_udf("int")
    def value(x: pd.Series, y: pd.Series, most: pd.Series, bound: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for m in np.unique(most):
            mine = (most == m).to_numpy()
            out[mine] = escape_counts(x[mine].to_numpy(), y[mine].to_numpy(), int(m), float(bound.iloc[0]))
        return pd.Series(out)

    return value(cx, cy, max_iter, escape2)


def mandelbrot(grid: DataFrame, max_iter: int = 1600, escape2: float = BOUND2) -> DataFrame:
    """`row, col, n` of the escape-time fractal."""
    return compute(grid, lambda x, y: escape_counts(x, y, max_iter, escape2)).select("row", "col", "n")


def colours(counts: DataFrame) -> DataFrame:
    """Adds `r, g, b`, a band of counts each: black to red, black to green, black to blue, blue to magenta, magenta to white; white above."""
    n = F.col("n")
    below = lambda k: n < k * BAND
    r = F.when(below(1), n).when(below(2), 0).when(below(3), 0).when(below(4), n - 3 * BAND).when(below(5), 255).otherwise(255)
    g = F.when(below(1), 0).when(below(2), n - BAND).when(below(3), 0).when(below(4), 0).when(below(5), n - 4 * BAND).otherwise(255)
    b = F.when(below(1), 0).when(below(2), 0).when(below(3), n - 2 * BAND).when(below(5), 255).otherwise(255)
    return counts.withColumns({"r": r.cast("int"), "g": g.cast("int"), "b": b.cast("int")})


def flipped(image: DataFrame, height: int) -> DataFrame:
    """The image upside down."""
    return image.withColumn("row", F.lit(height - 1) - F.col("row"))


def tile_stats(counts: DataFrame, grain: int, width: int, owners: int) -> DataFrame:
    """`owner, tiles, total, most`: tiles and iterations of each owner (tiles are dealt in turn) and the largest total of all."""
    across = -(-width // grain)
    tile = F.floor(F.col("row") / grain) * across + F.floor(F.col("col") / grain)
    by_tile = counts.groupBy(tile.alias("tile")).agg(F.sum(F.col("n").cast("long")).alias("total"))
    by_owner = by_tile.groupBy((F.col("tile") % owners).cast("int").alias("owner")).agg(F.count("*").alias("tiles"), F.sum("total").alias("total"))
    most = by_owner.agg(F.max("total").alias("most"))
    return by_owner.join(F.broadcast(most), F.lit(True))
