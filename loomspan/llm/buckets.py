"""Coarse groups of rows that share hash buckets, without listing the pairs of a bucket."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import runs
from ..scratch import drop, written
from .components import Joined, connected_components

#: Members of a block of a group of up to BASE members, and steps towards the last centre before the rest is compared in blocks.
BLOCK, BASE, DOUBLINGS = 64, 1024, 3


class Likeness:
    """How two payloads are compared: bytes to a row of numbers, and a score that must reach `least`. Payloads of different lengths are not alike."""

    def __init__(self, kind: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> None:
        self.kind, self.score, self.least = kind, score, least

    def rows(self, payloads: list[bytes]) -> np.ndarray:
        """Payloads of one length as rows of numbers."""
        return np.frombuffer(b"".join(payloads), self.kind).reshape(len(payloads), -1)


def _by_length(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of equal sizes."""
    for n in np.unique(size).tolist():
        yield np.flatnonzero(size == n)


def side(members: str):
    """How many of a group's members make a block: more in larger groups, so that what is sent for m members grows as m to the power 1.5."""
    return F.lit(BLOCK) * F.greatest(F.lit(1.0), F.sqrt(F.col(members) / BASE))


def at(count: str):
    """The block of a row, out of so many."""
    return F.pmod(F.xxhash64("id"), count).cast("int")


def every(count: str):
    """A row for each of so many blocks."""
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _alike(like: Likeness):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("siga").to_pylist(), batch.column("sigb").to_pylist()
            size = np.array([len(x) if len(x) == len(y) else -1 for x, y in zip(one, two)])
            alike = np.zeros(batch.num_rows, bool)
            for mine in _by_length(size):
                if size[mine[0]] >= 0:
                    alike[mine] = like.score(*(like.rows([x[k] for k in mine.tolist()]) for x in (one, two))) >= like.least
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    return keep


def _blockwise(like: Likeness):
    """From bucket members dealt to pairs of blocks: pairs that join the groups of those outside the main one (side 0) with others, as few as do so."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["bkey", "x", "y"]):
            ids, comp, first = (run.column(c).to_numpy() for c in ("id", "comp", "side"))
            joined, found = Joined(), []
            held = run.column("sig").to_pylist()
            for mine in _by_length(np.array([len(x) for x in held])):
                sig = like.rows([held[k] for k in mine.tolist()])
                left, right = np.flatnonzero(first[mine] == 0), np.flatnonzero(first[mine] == 1)
                for i in left.tolist():
                    other = right[comp[mine[right]] != comp[mine[i]]]
                    score = like.score(sig[other], sig[i])
                    o, score = mine[other[score >= like.least]], score[score >= like.least]
                    if len(o):
                        order = np.lexsort((-score, comp[o]))
                        best = order[np.unique(comp[o][order], return_index=True)[1]]
                        found += [(ids[mine[i]], ids[j]) for j in o[best].tolist() if joined.join(int(comp[mine[i]]), int(comp[j]))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return keep


def coarse_groups(rows: DataFrame, sigs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Groups over `rows (bkey, id)` and payloads `sigs (id, sig)`: `(id, comp)` of grouped rows, and `(id, w)`.

    Two rows of a bucket whose payloads are alike end in the same group, for all of them: each row
    is compared with a centre (the member of its buckets that shares most rows with others, `w`);
    then, in buckets that still hold several groups, rows outside the main group with all others,
    block against block. A pair of blocks gives fewer pairs than it has groups.
    """
    shared = rows.groupBy("bkey").agg(F.count("*").alias("m")).where("m > 1")
    buckets = written(rows.join(shared, "bkey"), "buckets")
    weight = written(buckets.groupBy("id").agg(F.sum("m").alias("w")), "weight")
    weighed = buckets.join(weight, "id")
    centre = weighed.groupBy("bkey").agg(F.max(F.struct("w", (-F.col("id")).alias("neg"))).alias("top"))
    star = weighed.join(centre, "bkey").where("top.neg <> -id").groupBy("id").agg(F.max("top").alias("top")).select(F.col("id").alias("a"), (-F.col("top.neg")).alias("b"))
    pairs = star.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("siga")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sigb")), "b")
    rough = written(pairs.mapInArrow(_alike(like), "a long, b long"), "rough")
    # each row points to a centre of higher rank: a few doublings bring most rows to their last one
    coarse = rough.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(DOUBLINGS):
        onward = coarse.select(F.col("id").alias("component"), F.col("component").alias("next"))
        before, coarse = coarse, written(coarse.join(onward, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "pointers")
        drop(before)

    held = written(weighed.join(coarse, "id", "left").select("bkey", "id", "m", "w", F.coalesce("component", "id").alias("comp")), "held")
    major = held.groupBy("bkey").agg(F.max(F.struct("w", (-F.col("id")).alias("neg"), "comp")).alias("top")).select("bkey", F.col("top.comp").alias("major"))
    told = held.join(major, "bkey")
    split = told.where("comp <> major").groupBy("bkey").agg(F.count("*").alias("out"))
    left = told.join(split, "bkey").join(sigs, "id").withColumn("nx", F.ceil(F.col("out") / side("m")).cast("int")).withColumn("ny", F.ceil(F.col("m") / side("m")).cast("int"))
    cols = ["bkey", "x", "y", "side", "id", "comp", "sig"]
    ones = left.where("comp <> major").withColumn("side", F.lit(0)).withColumn("x", at("nx")).withColumn("y", every("ny"))
    others = left.withColumn("side", F.lit(1)).withColumn("y", at("ny")).withColumn("x", every("nx"))
    left = ones.select(cols).union(others.select(cols))
    more = left.repartition("bkey", "x", "y").sortWithinPartitions("bkey", "x", "y").mapInArrow(_blockwise(like), "a long, b long").distinct()
    both = written(rough.union(more), "rough")
    groups = connected_components(both).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    drop(buckets, rough, coarse, held, both)
    return groups, weight
