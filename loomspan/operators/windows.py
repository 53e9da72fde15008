"""Folds over the last k elements of an ordered column."""

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .positions import over_neighbours, with_position


def window_reduce(df: DataFrame, k: int, order: list[str], aggregates: dict[str, Callable[[], Column]], partition_by: list[str] | None = None) -> DataFrame:
    """Adds aggregates over each row and the k - 1 before it; rows with fewer before them go.

    With `partition_by` this is one window; without, the table is ordered by ranges and each chunk
    gets the k - 1 rows before it, so that no task holds all rows.
    """
    if k < 1:
        raise ValueError("a window has at least one element")
    if partition_by:
        w = W.partitionBy(*partition_by).orderBy(*order)
        frame = w.rowsBetween(-(k - 1), 0)
        out = df.withColumns({n: f().over(frame) for n, f in aggregates.items()}).withColumn("loomspan_n", F.row_number().over(w))
        return out.where(F.col("loomspan_n") >= k).drop("loomspan_n")
    placed = with_position(df, order, "loomspan_pos")
    columns = {n: (lambda w, f=f: f().over(w.rowsBetween(-(k - 1), 0))) for n, f in aggregates.items()}
    return over_neighbours(placed, "loomspan_pos", k - 1, 0, columns).where(F.col("loomspan_pos") >= k - 1).drop("loomspan_pos")


def window_fold(df: DataFrame, k: int, order: list[str], value: str, op: Callable[[Column, Column], Column] | str, zero: Column | str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Left fold, oldest to newest, of each window by an associative operation that may not commute.

    The operation is a function of columns (older, newer), or SQL text over `a` and `b` with the
    zero as SQL text, which may be read at run time.
    """
    out = window_reduce(df, k, order, {"loomspan_list": lambda: F.collect_list(value)}, partition_by)
    if isinstance(op, str):
        folded = F.expr(f"aggregate(loomspan_list, {zero}, (a, b) -> {op})")
    else:
        folded = F.aggregate("loomspan_list", zero, op)
    return out.withColumn(name, folded).drop("loomspan_list")


def window_fold_python(df: DataFrame, k: int, order: list[str], value: str, op: Callable, kind: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """`window_fold` for a Python function of two values, applied to Arrow batches of windows."""

    @F.pandas_udf(kind)
    def fold(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: reduce(op, xs))

    out = window_reduce(df, k, order, {"loomspan_list": lambda: F.collect_list(value)}, partition_by)
    return out.withColumn(name, fold("loomspan_list")).drop("loomspan_list")


def read_operator(spark: SparkSession, path: str) -> str:
    """The SQL text of an operation over `a` and `b` from a file, without its comment lines (`--`)."""
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()
    return " ".join(x for x in lines if x.strip() and not x.lstrip().startswith("--"))


def latest(df: DataFrame, k: int, order: list[str], aggregates: dict[str, Callable[[], Column]]) -> DataFrame:
    """The row of the newest window of `window_reduce`: only the last k rows are kept of each task, and folded; no row if there are fewer."""
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(k)
    return window_reduce(last.withColumn("loomspan_one", F.lit(0)), k, order, aggregates, ["loomspan_one"]).drop("loomspan_one")
