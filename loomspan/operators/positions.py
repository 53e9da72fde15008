"""A total order over a distributed table: sorted rows with their place, without a single-task window."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import written

_MASK = (1 << 33) - 1


def with_position(df: DataFrame, order: list, position: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """`df`, or its columns `keep`, with the place of each row (from 0) in the given order.

    Rows are dealt by ranges of the order and sorted in each; the table is written once, so ranges
    are not sampled anew; then only one count for each range is summed up. The order must be total
    for the places to be the same on every run.
    """
    placed, part = _ranged(df, order, keep)
    counts = placed.groupBy(part.alias("loomspan_part")).agg(F.count("*").alias("n"))
    out = placed.withColumn("loomspan_part", part).join(F.broadcast(_before(counts)), "loomspan_part")
    return out.withColumn(position, F.col("loomspan_before") + F.col("loomspan_at").bitwiseAND(F.lit(_MASK))).drop("loomspan_at", "loomspan_part", "loomspan_before")


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """`df` with the sum of a column up to and with each row in a given total order; only one sum for each range is put in one place."""
    placed, part = _ranged(df, order)
    placed = placed.withColumn("loomspan_part", part)
    sums = placed.groupBy("loomspan_part").agg(F.sum(value).alias("n"))
    inside = F.sum(value).over(W.partitionBy("loomspan_part").orderBy("loomspan_at").rowsBetween(W.unboundedPreceding, 0))
    out = placed.withColumn("loomspan_inside", inside).join(F.broadcast(_before(sums)), "loomspan_part")
    return out.withColumn(name, F.col("loomspan_before") + F.col("loomspan_inside")).drop("loomspan_at", "loomspan_part", "loomspan_before", "loomspan_inside")


def _ranged(df: DataFrame, order: list, keep: list[str] | None = None) -> tuple[DataFrame, Column]:
    """Rows in ranges of an order, written (their columns `keep` or all), with `loomspan_at` in that order, and the range of a row."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("loomspan_at", F.monotonically_increasing_id())
    return written(placed if keep is None else placed.select(*keep, "loomspan_at"), "ordered"), F.shiftrightunsigned("loomspan_at", 33)


def _before(parts: DataFrame) -> DataFrame:
    """`loomspan_part, loomspan_before`: the sum of `n` over all ranges before each; at most a row for each shuffle partition."""
    over = W.orderBy("loomspan_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("loomspan_part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("loomspan_before"))


def over_neighbours(df: DataFrame, position: str, before: int, after: int, columns: dict[str, callable], chunk: int = 1 << 17) -> DataFrame:
    """Adds window columns over rows near in a position column, chunk by chunk.

    Each chunk also gets the rows within `before` and `after` of its ends, so a frame of that
    reach is whole; `columns` maps a name to a function from a window order to a column.
    """
    chunk = max(chunk, before + after + 1)
    at = F.col(position)
    home = F.floor(at / chunk)
    to = F.array_distinct(F.array(home, F.floor((at + before) / chunk), F.floor((at - after) / chunk)))
    dealt = df.withColumn("loomspan_home", home).withColumn("loomspan_chunk", F.explode(to))
    order = W.partitionBy("loomspan_chunk").orderBy(position)
    return dealt.withColumns({name: f(order) for name, f in columns.items()}).where("loomspan_home = loomspan_chunk").drop("loomspan_home", "loomspan_chunk")


def sorted_rows(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """A global ascending sort: range exchange and sort in each partition."""
    return df.orderBy(*order)
