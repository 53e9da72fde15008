"""Global sorts, merges of sorted runs, searches in sorted runs and order checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import over_neighbours, running_total, with_position


def sort_with_place(df: DataFrame, order: list, position: str = "pos") -> DataFrame:
    """Rows with their place in the ascending order; give a full tie-break for a stable result.

    Merge sort, its unbalanced and parallel forms and quicksort differ in how they split the work,
    not in this result; here the split is by sampled ranges.
    """
    return with_position(df, order, position)


def merge_runs(left: DataFrame, right: DataFrame, value: str, place: str) -> DataFrame:
    """The stable merge of two sorted runs: `run` (0 or 1), the columns, and `pos`; on ties the left run comes first."""
    both = left.withColumn("run", F.lit(0)).unionByName(right.withColumn("run", F.lit(1)))
    return with_position(both, [value, "run", place])


def equal_ranges(df: DataFrame, value: str) -> DataFrame:
    """For each value its first and last place in the ascending order: `value, first_pos, last_pos`.

    Rows are counted by value first; only distinct values are put in order, and their counts summed up.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("loomspan_n"))
    total = running_total(counts, [value], "loomspan_n", "loomspan_end")
    return total.select(value, (F.col("loomspan_end") - F.col("loomspan_n")).alias("first_pos"), (F.col("loomspan_end") - 1).alias("last_pos"))


def equal_range(df: DataFrame, value: str, x) -> DataFrame:
    """The first place in the ascending order whose value is not below x and the last whose value is not above it; null if there is none. One scan counts them."""
    below, to = F.count_if(F.col(value) < x), F.count_if(F.col(value) <= x)
    return df.agg(F.when(below < F.count(value), below).alias("first_pos"), F.when(to > 0, to - 1).alias("last_pos"))


def partition3(df: DataFrame, value: str, pivot) -> DataFrame:
    """Adds `part`: -1 below, 0 at, 1 above the pivot."""
    return df.withColumn("part", F.when(F.col(value) < pivot, -1).when(F.col(value) > pivot, 1).otherwise(0))


def order_violations(df: DataFrame, value: str, order: list[str], context: int = 10) -> DataFrame:
    """`pos, previous, value, around`: every place whose value is below the one before, with the values up to `context` (1 at least) before and after it.

    The values around are a frame of the same window, so a row is sent twice, whatever the number of violations.
    """
    if context < 1:
        raise ValueError("a violation has at least the value before it")
    placed = with_position(df, order, keep=[value]).select("pos", F.col(value).alias("value"))
    frame = {"previous": lambda w: F.lag("value").over(w), "around": lambda w: F.collect_list(F.struct("value")).over(w.rowsBetween(-context, context - 1))}
    near = over_neighbours(placed, "pos", context, context - 1, frame)
    return near.where(F.col("value") < F.col("previous")).select("pos", "previous", "value", F.col("around.value").alias("around"))


def is_sorted(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """`sorted`: whether no value is below the one before it; true for no rows."""
    near = over_neighbours(with_position(df, order), "pos", 1, 0, {"loomspan_prev": lambda w: F.lag(value).over(w)})
    return near.agg(F.coalesce(F.every((F.col(value) >= F.col("loomspan_prev")) | F.col("loomspan_prev").isNull()), F.lit(True)).alias("sorted"))


def descending(column: Column) -> Column:
    """An order key for `with_position` that puts large values first."""
    return column.desc()
