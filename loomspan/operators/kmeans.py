"""k-means from an initial assignment: assign, mean, repair; restarts; tolerance.

A round is one pass over the points: each Arrow batch is assigned to the nearest centre with numpy
and summed, and only k rows for each partition leave it. The plan of a round reads the points and
the current centres, never an earlier round's result, so the lineage stays flat.
"""

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import count as counted

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import nearest

#: Partial sums that the driver adds up itself (8 MB); more of them are added by tasks.
DRIVER_VALUES = 1 << 20


@dataclass
class Clustering:
    """Centres (k x D), their weights, rounds, whether it converged, inertia of the last assignment, and points moved by repairs."""

    centres: np.ndarray
    weights: np.ndarray
    rounds: int
    converged: bool
    inertia: float
    moved: dict[int, int] = field(default_factory=dict)
    inertias: list[float] = field(default_factory=list)


def points(df: DataFrame, id_col: str, vector_col: str, weight: Column | None = None) -> DataFrame:
    """`point_id, coords array<double>, weight`; rows with a null id or vector go. All vectors must have the first one's length."""
    one = F.lit(1.0) if weight is None else weight.cast("double")
    return df.select(F.col(id_col).cast("long").alias("point_id"), F.col(vector_col).cast("array<double>").alias("coords"), one.alias("weight")).where("point_id is not null and coords is not null")


def round_robin(k: int) -> Column:
    """The deterministic initial assignment: point_id modulo k."""
    return F.pmod(F.col("point_id"), F.lit(k)).cast("int")


def scattered(k: int, seed: int) -> Column:
    """A seeded pseudo-random initial assignment that depends on the id alone, so it is the same on every read."""
    low = F.lit((1 << 31) - 1)  # only these bits of the product count, so only these of the id: no product leaves 64 bits
    return F.pmod(F.shiftrightunsigned((F.col("point_id").bitwiseAND(low) * 1103515245 + 12345 * (seed + 1)).bitwiseAND(low), 8), F.lit(k)).cast("int")


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("coords").flatten().to_numpy(zero_copy_only=False)
    if len(x) != batch.num_rows * dim:
        raise ValueError(f"a point has not {dim} coordinates")
    return batch.column("point_id").to_numpy(), x.reshape(-1, dim), batch.column("weight").to_numpy()


def _assigned(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, centres: np.ndarray, moved: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    mean = np.ascontiguousarray((x / weight[:, None]).T)  # a row for each dimension, read once a centre
    dist, apart = np.empty((len(ids), len(centres))), np.empty(len(ids))
    for k, c in enumerate(centres):
        total = np.zeros(len(ids))
        for j in range(len(c)):
            np.subtract(mean[j], c[j], out=apart)
            np.square(apart, out=apart)
            total += apart
        dist[:, k] = total
    best = dist.argmin(1)
    for i in np.flatnonzero(np.isin(ids, list(moved))).tolist() if moved else []:
        best[i] = moved[int(ids[i])]
    return best, dist[np.arange(len(ids)), best]


def _sums(df: DataFrame, dim: int, k: int, centres: np.ndarray | None, moved: dict[int, int], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Coordinate sums, weights and counts of each cluster, and inertia; `df` has so many partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, dim + 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, weight = _matrix(batch, dim)
            if centres is None:
                best, dist = batch.column("start").to_numpy(), np.zeros(len(ids))
            else:
                best, dist = _assigned(ids, x, weight, centres, moved)
            for c in range(k):
                mine = best == c
                out[c] += np.concatenate([x[mine].sum(0), [weight[mine].sum(), mine.sum(), dist[mine].sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(out), pa.list_(pa.float64()))], ["c", "s"])

    made = df.mapInArrow(run, "c long, s array<double>")
    # in an order of their own, so that equal centres give equal sums
    if parts * k * (dim + 3) <= DRIVER_VALUES:  # a round is then one job of one stage
        rows = made.collect()
        mine = [[r["s"] for r in rows if r["c"] == c] for c in range(k)]
        out = np.array([np.sort(np.array(m).reshape(-1, dim + 3), axis=0).sum(0) for m in mine])
        return out[:, :dim], out[:, dim], out[:, dim + 1], float(out[:, dim + 2].sum())
    # k * (D + 3) rows
    added = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, v: a + v)
    total = made.select("c", F.posexplode("s").alias("j", "v")).groupBy("c", "j").agg(added.alias("v")).collect()
    out = np.zeros((k, dim + 3))
    for r in total:
        out[r["c"], r["j"]] = r["v"]
    return out[:, :dim], out[:, dim], out[:, dim + 1], float(out[:, dim + 2].sum())


def _same(df: DataFrame, centres: np.ndarray, moved: dict[int, int], fresh: np.ndarray) -> bool:
    """Whether centres made from the assignment of others give that assignment again.

    Equal ones do. Sums of a frame that is not read in one order differ in their last bits, so for
    centres as near as that the points are asked.
    """
    if np.array_equal(fresh, centres, equal_nan=True):
        return True
    if not np.allclose(fresh, centres, rtol=1e-9, atol=1e-12, equal_nan=True):
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if batch.num_rows:
                point = _matrix(batch, centres.shape[1])
                n += int((_assigned(*point, centres, moved)[0] != _assigned(*point, fresh, {})[0]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.select("point_id", "coords", "weight").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] == 0


def _repair(df: DataFrame, k: int, counts: np.ndarray, centres: np.ndarray | None, moved: dict[int, int]) -> dict[int, int] | None:
    """Points to move into empty clusters: the farthest of clusters with more than one, lowest id on ties; None if there is none."""
    moved, counts = dict(moved), counts.copy()
    placed = assign(df, centres, moved) if centres is not None else df.select("point_id", F.col("start").alias("cluster_id"), F.lit(0.0).alias("dist"))
    empty = np.flatnonzero(counts == 0).tolist()
    # a cluster can lose all its points but one: at most as many as are empty are moved
    far = placed.where(F.col("cluster_id").isin([c for c in range(k) if counts[c] > 1])).orderBy(F.col("dist").desc(), "point_id").limit(len(empty) * (k + 1)).collect()
    new: dict[int, int] = {}
    for c in empty:
        for r in far:
            if r["point_id"] not in new and counts[r["cluster_id"]] > 1:
                new[r["point_id"]] = c
                counts[r["cluster_id"]] -= 1
                counts[c] = 1
                break
        else:
            return None
    return moved | new


def kmeans(df: DataFrame, k: int, start: Column, max_iter: int | None = None, tolerance: float | None = None, keep: bool = True) -> Clustering | None:
    """Rounds of centres and assignment from an initial assignment, until no assignment changes.

    There is no other end unless `max_iter` is given, but for centres that an earlier round had: repairs
    can go round in a circle. `converged` is false for both.
    With a tolerance it stops as soon as (previous - current) / current inertia is not above it;
    the returned centres are then those that made the last assignment. Points whose cluster was
    empty are repaired as `_repair` says; None if that can't be done. `df` is as from `points`.
    """
    df = df.withColumn("start", start)
    if keep:
        df = df.persist()
    try:
        first = df.select(F.size("coords").alias("d")).first()
        if first is None:
            return None
        parts = df.rdd.getNumPartitions()
        dim, centres, moved, inertias, seen = first["d"], None, {}, [], set()
        for turn in counted(1) if max_iter is None else range(1, max_iter + 2):
            sums, weights, counts, inertia = _sums(df, dim, k, centres, moved, parts)
            if centres is not None:
                inertias.append(inertia)
                # centres that their own assignment makes again: the next round would change none
                done = (counts > 0).all() and _same(df, centres, moved, sums / weights[:, None]) if tolerance is None else len(inertias) > 1 and (inertias[-2] - inertia) <= tolerance * inertia
                again = centres.tobytes() in seen
                seen.add(centres.tobytes())
                if done or again or (max_iter is not None and turn > max_iter):
                    return Clustering(centres, weights, turn - 1, bool(done), inertia, moved, inertias)
            if (counts == 0).any():
                fixed = _repair(df, k, counts, centres, moved)
                if fixed is None:
                    return None
                if centres is None:
                    where = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
                    df = df.withColumn("start", F.coalesce(where[F.col("point_id")], F.col("start")).cast("int"))
                    sums, weights, counts, _ = _sums(df, dim, k, None, {}, parts)
                else:
                    sums, weights, counts, _ = _sums(df, dim, k, centres, fixed, parts)
                    moved = fixed
            centres, moved = sums / weights[:, None], {}
        return None
    finally:
        if keep:
            df.unpersist()


def assign(df: DataFrame, centres: np.ndarray, moved: dict[int, int] | None = None) -> DataFrame:
    """`point_id, cluster_id, dist` by numpy on Arrow batches: the nearest centre, the lowest id on ties."""
    centres, moved = np.asarray(centres, float), moved or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x, weight = _matrix(batch, centres.shape[1])
                best, dist = _assigned(ids, x, weight, centres, moved)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best.astype(np.int32)), pa.array(dist)], ["point_id", "cluster_id", "dist"])

    return df.select("point_id", "coords", "weight").mapInArrow(run, "point_id long, cluster_id int, dist double")


def assign_expr(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """`assign` without Python: centres as literals, nothing is joined or shuffled."""
    best = nearest(F.col("coords"), centres)
    return df.select("point_id", best.alias("b")).select("point_id", "b.cluster_id", "b.dist")


def cluster_means(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """`cluster_id, pos, mean, n`: the mean of each dimension of each cluster."""
    long = df.select(F.col(cluster).alias("cluster_id"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    return long.groupBy("cluster_id", "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def farthest_point(assigned: DataFrame) -> DataFrame:
    """`point_id, cluster_id, dist` of the farthest point among clusters with more than one, the lowest id on ties."""
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")
    best = F.max_by(F.struct("point_id", "cluster_id", "dist"), F.struct("dist", (-F.col("point_id")).alias("neg")))
    return assigned.join(F.broadcast(sizes), "cluster_id", "left_semi").agg(best.alias("b")).where("b is not null").select("b.*")


def inertia(assigned: DataFrame) -> DataFrame:
    """`inertia`: the sum of distances."""
    return assigned.agg(F.sum("dist").alias("inertia"))


def changed_count(new: DataFrame, old: DataFrame) -> DataFrame:
    """`changed, any_changed`: points whose cluster differs between two assignments."""
    both = new.select("point_id", F.col("cluster_id").alias("a")).join(old.select("point_id", F.col("cluster_id").alias("b")), "point_id")
    return both.agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"), F.bool_or(F.col("a") != F.col("b")).alias("any_changed"))


def trials(df: DataFrame, k: int, count: int, start: Callable[[int], Column] | None = None, parallel: int = 1, **options) -> list[tuple[int, Clustering]]:
    """Restarts from seeded assignments; the results of all that succeed, by trial.

    `parallel` trials run at a time: their jobs share the executors, as the driver only waits for sums.
    """
    begin = start or (lambda t: scattered(k, t))
    df = df.persist()  # the points are read once for all trials
    try:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            made = list(pool.map(lambda t: (t, kmeans(df, k, begin(t), keep=False, **options)), range(count)))
    finally:
        df.unpersist()
    return [(t, c) for t, c in made if c is not None]
