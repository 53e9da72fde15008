"""Pipelines, word counts and count windows over unbounded inputs."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import lines_of, words_on_space
from ..scratch import new_path


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema of those that are there."""
    read = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # a stream watches folders; one file is its folder with a filter on the name
        return read.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return read.parquet(path)


def pipeline(stream: DataFrame, *stages: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """Map stages over one column, in order; they run as one pipelined stage."""
    column = F.col(value)
    for stage in stages:
        column = stage(column)
    return stream.withColumn(value, column)


def stream_word_count(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """`word, n` over all that has come."""
    words = lines_of(stream, text_col).select(F.explode(words_on_space(F.col("value"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _folds(values: np.ndarray | list, k: int, op: Callable | str) -> list:
    """The fold of each run of k values, oldest first."""
    if isinstance(op, str):
        runs = np.lib.stride_tricks.sliding_window_view(np.asarray(values), k)
        return getattr(runs, op)(1).tolist()
    out = []
    for end in range(k, len(values) + 1):
        total = values[end - k]
        for x in values[end - k + 1 : end]:
            total = op(total, x)
        out.append(total)
    return out


def count_windows(stream: DataFrame, k: int, key: str, order: list[str], value: str, op: Callable | str, kind: str = "double") -> DataFrame:
    """`<key>, <order>, result`: for each row the fold of the last k values of its key, oldest first, from the k-th row on.

    The operation is "sum", "min" or "max", for which numpy folds all windows at once, or a function
    of two values. The state of a key is its last k - 1 values. Rows are put in order inside a
    micro-batch, where a key's rows are held at once (the source's files per batch bound them);
    across micro-batches the order is that of arrival.
    """
    if isinstance(op, str) and op not in ("sum", "min", "max"):
        raise ValueError(f"no such operation: {op}")
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"{c} {fields[c]}" for c in [key, *order]) + f", result {kind}"

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        early = max(0, k - 1 - len(held))
        held += rows[value].tolist()
        out_rows = rows[[key, *order]].iloc[early:]
        state.update((held[-(k - 1) :] if k > 1 else [],))
        yield out_rows.assign(result=_folds(held, k, op) if len(held) >= k else [])

    picked = stream.select(key, *order, value)
    return picked.groupBy(key).applyInPandasWithState(run, out, f"held array<{fields[value]}>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, run through the stream and written as Parquet (append mode) in the shared folder."""
    spark = stream.sparkSession
    path, marks = new_path(spark, name), new_path(spark, name + "-marks")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The last result of an aggregation (complete mode): each micro-batch writes its own folder, the newest is read."""
    spark = stream.sparkSession
    path, marks = new_path(spark, name), new_path(spark, name + "-marks")
    newest = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch}")
        newest[:] = [batch]

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{newest[0]}") if newest else spark.createDataFrame([], stream.schema)


def to_console(stream: DataFrame, mode: str = "append"):
    """The running query that prints a stream; stop() and awaitTermination() end or join it."""
    return stream.writeStream.format("console").outputMode(mode).start()


def drained(stream: DataFrame, f: Callable):
    """The running query that calls f with each row, on the executors."""
    return stream.writeStream.foreach(f).start()
