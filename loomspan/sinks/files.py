"""Text, report, plot and image outputs."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmeans import Clustering
from ..sources.files import point_file, report_blocks

REPORT_COLUMNS = ["threads", "size", "threshold", "chrono", "parameters"]


def drain(df: DataFrame, f: Callable) -> None:
    """Calls f with each row, on the executors."""
    df.foreach(f)


def key_value_text(df: DataFrame, key: str, value: str, path: str, mode: str = "overwrite") -> None:
    """`key value` on a line for each row, in no particular order; no rows give an empty output with a success mark."""
    df.select(F.concat_ws(" ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)


def report_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "append") -> None:
    """`;`-separated report rows with a header; columns out of REPORT_COLUMNS in the given order."""
    wanted = columns or [c for c in REPORT_COLUMNS if c in df.columns]
    wrong = [c for c in wanted if c not in REPORT_COLUMNS]
    if wrong:
        raise ValueError(f"unknown report columns: {', '.join(wrong)}")
    df.select(*wanted).write.mode(mode).option("sep", ";").option("header", True).csv(path)


def sorted_files(df: DataFrame, order: list[str], path: str, by: list[str] | None = None) -> None:
    """Sorted rows as text: a folder for each combination of `by`, or one output in global order."""
    columns = [c for c in df.columns if c not in (by or [])]
    if by:
        dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
        dealt.select(*by, F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)
    else:
        df.orderBy(*order).select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)


def cluster_report(assigned: DataFrame, found: Clustering, path: str, options: dict | None = None, append: bool = False) -> None:
    """Text: options, centres, then `id:<cluster> d²=<distance>` for each point by id.

    Lines are ordered by ranges; the parts in name order are the report.
    """
    spark = assigned.sparkSession
    head = [";".join(options or {}), ";".join(map(str, (options or {}).values())), "centroids"] + [" ".join([*map(repr, c.tolist()), repr(float(w))]) for c, w in zip(found.centres, found.weights)] + ["assignments"]
    top = spark.createDataFrame([(-len(head) + k, x) for k, x in enumerate(head)], "point_id long, value string")
    body = assigned.select("point_id", F.concat(F.lit("id:"), F.col("cluster_id"), F.lit(" d²="), F.col("dist")).alias("value"))
    top.union(body).orderBy("point_id").select("value").write.mode("append" if append else "overwrite").text(path)


def positional_join(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """The i-th point with the i-th reported row of each block; blocks of another length than the points are left out.

    Both sides carry their place as `point_id`, so this is an equi-join.
    """
    n = points.agg(F.count("*").alias("n_points"))
    whole = blocks.groupBy("trial").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_points"), "left_semi").select("trial")
    return points.join(blocks.join(F.broadcast(whole), "trial", "left_semi"), "point_id")


def plot_files(spark, points_path: str, report_path: str, out: str) -> None:
    """A folder for each trial with `coords... cluster_id` lines; its parts in name order are the points in theirs."""
    joined = positional_join(point_file(spark, points_path), report_blocks(spark, report_path))
    line = F.concat_ws(" ", F.concat_ws(" ", F.col("coords").cast("array<string>")), F.col("cluster_id"))
    # by ranges of both, so a trial of many points is not one task's
    joined.repartitionByRange("trial", "point_id").sortWithinPartitions("trial", "point_id").select("trial", line.alias("value")).write.mode("overwrite").partitionBy("trial").text(out)


def write_ppm(image: DataFrame, width: int, height: int, path: str) -> None:
    """A binary PPM image from `row, col, r, g, b`. The raster (width * height * 3 bytes) is made by the driver, a row of pixels at a time."""
    packed = F.concat(*[F.unhex(F.lpad(F.hex(F.col(c)), 2, "0")) for c in "rgb"])
    rows = image.select("row", "col", packed.alias("p")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "p"))).alias("ps"))
    data = np.zeros((height, width * 3), np.uint8)
    for r in rows.select("row", F.aggregate("ps", F.lit(b""), lambda s, x: F.concat(s, x["p"])).alias("line")).toLocalIterator():
        data[r["row"]] = np.frombuffer(bytes(r["line"]), np.uint8)
    with open(path, "wb") as f:
        f.write(f"P6\n{width} {height}\n255\n".encode())
        f.write(data.tobytes())
