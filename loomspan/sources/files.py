"""Text, point, integer and report files, and unbounded element streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.positions import over_neighbours
from ..scratch import written


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, block, value`: all lines with their file and the start of the part of it that a task reads."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _in_read_order(rows: DataFrame) -> DataFrame:
    """Rows of `_lines` with `pos`, their place over the files in name order.

    A part's rows are written as they are read, in their order; only a count for each part is summed up,
    so nothing is sorted and no row is shuffled.
    """
    kept = written(rows.withColumn("at", F.monotonically_increasing_id()), "lines")
    parts = kept.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("file", "block", (earlier - F.col("least")).alias("shift"))
    return kept.join(F.broadcast(shift), ["file", "block"]).withColumn("pos", F.col("at") + F.col("shift")).drop("block", "at", "shift")


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, value, pos`: all lines with their place over the files in name order. Large files are read in parts."""
    return _in_read_order(_lines(spark, path))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, line_no, value` in file order, blank lines kept."""
    lines = _ordered_lines(spark, path)
    first = lines.groupBy("file").agg(F.min("pos").alias("first"))
    return lines.join(F.broadcast(first), "file").select("file", (F.col("pos") - F.col("first")).alias("line_no"), "value")


def point_file(spark: SparkSession, path: str) -> DataFrame:
    """`point_id, coords, weight` from lines of floats between white space; D is the first line's and every other must have it.

    A folder's files are one file, in name order, so a large one can be written by many tasks.
    """
    lines = _ordered_lines(spark, path).where(F.trim("value") != "")
    coords = lines.select("pos", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").cast("array<float>").alias("coords"))
    dims = coords.agg(F.min_by(F.size("coords"), "pos").alias("d"))
    wrong = F.concat(F.lit("line "), F.col("pos") + 1, F.lit(" has "), F.size("coords"), F.lit(" numbers, not "), F.col("d"))
    checked = coords.join(F.broadcast(dims), F.lit(True)).withColumn("coords", F.when(F.size("coords") == F.col("d"), F.col("coords")).otherwise(F.raise_error(wrong).cast("array<float>")))
    return checked.select(F.col("pos").alias("point_id"), "coords", F.lit(1.0).alias("weight"))


def int_file(spark: SparkSession, path: str) -> DataFrame:
    """`pos, v`: integers between any white space, up to the first part that is none."""
    words = _lines(spark, path).select("file", "block", F.explode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("w"))
    parts = _in_read_order(words.select("file", "block", F.expr("try_cast(w as int)").alias("v")))
    stop = parts.where("v is null").agg(F.min("pos").alias("stop"))
    return parts.join(F.broadcast(stop), F.lit(True)).where("stop is null or pos < stop").select("pos", "v")


def report_blocks(spark: SparkSession, path: str) -> DataFrame:
    """`trial, point_id, cluster_id, dist` from a cluster report: consecutive `id:` lines are a block, one for each trial."""
    lines = _ordered_lines(spark, path).select("pos", "value")
    is_row = F.col("value").startswith("id:")
    near = over_neighbours(lines, "pos", 1, 0, {"before": lambda w: F.lag("value").over(w)})
    starts = near.where(is_row & ~F.coalesce(F.col("before").startswith("id:"), F.lit(False))).select(F.col("pos").alias("start"))
    # one row for each trial from here on
    order = W.orderBy("start")
    starts = starts.select((F.row_number().over(order) - 1).alias("trial"), "start", F.lead("start").over(order).alias("next"))
    rows = lines.where(is_row).join(F.broadcast(starts), (F.col("pos") >= F.col("start")) & (F.col("next").isNull() | (F.col("pos") < F.col("next"))))
    pattern = r"id:(-?\d+) d²=(\S+)"
    return rows.select(F.col("trial").cast("int"), (F.col("pos") - F.col("start")).alias("point_id"), F.regexp_extract("value", pattern, 1).cast("int").alias("cluster_id"), F.regexp_extract("value", pattern, 2).cast("double").alias("dist"))


def element_stream(spark: SparkSession, **options) -> DataFrame:
    """An unbounded stream of values: `source=socket` with host and port, else `rate-micro-batch` or `rate`."""
    source = options.pop("source", "socket")
    return spark.readStream.format(source).options(**options).load()
