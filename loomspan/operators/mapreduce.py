"""Flat-map, combine and reduce by key; word counts."""

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_on_space_or_line, words_on_white_space
from .positions import with_position


def map_reduce(lines: DataFrame, mapper: Callable[[Column], Column], reducer: Callable[[Column], Column], value_col: str = "value") -> DataFrame:
    """`key, value`: the mapper gives each line an array of struct(key, value), the reducer is an aggregate of the values.

    Aggregates with a partial form are combined before the exchange.
    """
    pairs = lines.select(F.explode(mapper(F.col(value_col))).alias("kv")).select("kv.key", "kv.value")
    return pairs.groupBy("key").agg(reducer(F.col("value")).alias("value"))


def map_reduce_python(lines: DataFrame, mapper: Callable[[str], Iterable[tuple]], op: Callable, schema: str = "key string, value long", value_col: str = "value", most: int = 100_000) -> DataFrame:
    """`map_reduce` for Python functions: the mapper gives pairs for a line, the associative operation joins two values.

    Pairs are combined in the task that made them, in line order, up to `most` keys at a time;
    partial values keep their order in the final fold, so the operation need not commute.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held = TaskContext.get().partitionId(), 0, {}

        def flushed() -> pd.DataFrame:
            return pd.DataFrame({"key": list(held), "value": list(held.values()), "part": part, "seq": seq})

        for batch in batches:
            for line in batch[value_col]:
                for key, value in mapper(line):
                    held[key] = op(held[key], value) if key in held else value
                if len(held) >= most:
                    yield flushed()
                    seq, held = seq + 1, {}
        if held:
            yield flushed()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, any_ = None, None, False
        for batch in batches:
            out = []
            for key, value in zip(batch["key"].tolist(), batch["value"].tolist()):
                if any_ and key == now:
                    total = op(total, value)
                else:
                    if any_:
                        out.append((now, total))
                    now, total, any_ = key, value, True
            yield pd.DataFrame(out, columns=["key", "value"])
        if any_:
            yield pd.DataFrame([(now, total)], columns=["key", "value"])

    parts = lines.select(value_col).mapInPandas(combine, f"{schema}, part long, seq long")
    return parts.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "value").mapInPandas(fold, schema)


def reduce_by_key_ordered(df: DataFrame, key: str, value: str, order: list[str], op: Callable[[Column, Column], Column], name: str = "value", chunk: int | None = 4096) -> DataFrame:
    """Fold of each key's values in a given total order by an associative operation that may not commute; the order decides, not the partitioning.

    Rows are placed in order first and each run of `chunk` neighbouring rows of a key is folded
    alone, then the runs' results in order: a key with very many rows is spread over tasks and its
    rows are never one list. The result of an operation that joins its values (texts, lists) is as
    long as they are. `chunk=None` saves the ordering where every key is known to have few rows: then
    a key's rows are one list.
    """
    if chunk is None:
        return _fold_lists(df, [key], value, order, op).select(key, F.col("loomspan_v").alias(name))
    placed = with_position(df.select(*dict.fromkeys([key, value, *order])), [key, *order], "loomspan_pos")
    runs = placed.withColumn("loomspan_run", F.floor(F.col("loomspan_pos") / chunk))
    parts = _fold_lists(runs, [key, "loomspan_run"], value, ["loomspan_pos"], op)
    return _fold_lists(parts, [key], "loomspan_v", ["loomspan_run"], op).select(key, F.col("loomspan_v").alias(name))


def _fold_lists(df: DataFrame, keys: list[str], value: str, order: list[str], op: Callable[[Column, Column], Column]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(value).alias("loomspan_v"))))
    lists = df.groupBy(*keys).agg(rows.alias("rows"))
    rest = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    return lists.select(*keys, F.aggregate(rest, F.get("rows", F.lit(0))["loomspan_v"], lambda s, r: op(s, r["loomspan_v"])).alias("loomspan_v"))


def word_count(df: DataFrame, text_col: str = "text", white_space: bool = False) -> DataFrame:
    """`word, n` over all lines of a text column."""
    split = words_on_white_space if white_space else words_on_space_or_line
    words = df.select(F.explode(split(F.col(text_col))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))
