"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates a vector three times by random signs and a fast Hadamard transform and takes the
axis (with its sign) of the largest component; HASHES of them make a bucket of a table. A vector
goes to its bucket in each table and, by multiprobe, to those where one hash takes its second
largest axis. Vectors that share a bucket and reach the cosine are brought into one coarse group;
inside a group every pair is verified, block against block, and only counts and spanning links
come out, so a large group makes no list of its pairs.

Equal vectors with equal labels are one vector with a multiplicity. Three hashes make so many
buckets that unlike vectors seldom share one, also among very many of them.

Shapes of input with a defined result: vectors that are null, empty, zero, or hold null or
non-finite components, and vectors with a null label, link with nothing; vectors of different
lengths do not link; vectors of any length are worked on in runs of a bounded number of components;
a null id is given back unlinked with a null component; rows that share an id are one node of the
components, while each row counts its own links; repeated rows link with one another; an empty
table gives no rows; other columns are ignored, whatever their names are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import runs
from ..scratch import drop, written
from ._words import U, mix
from .buckets import Likeness, at, coarse_groups, every, side
from .components import connected_components

#: Tables, and hashes of a table. In 64 dimensions a pair at a cosine of 0.98 to 0.99 shares a bucket of one table with a probability of 0.95,
#: so eight tables miss one in 10^10; all pairs of the test tables were found.
TABLES, HASHES = 8, 3
#: Components that are worked on at once.
VALUES = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x


def bucket_keys(vectors: np.ndarray, salt: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = 11) -> np.ndarray:
    """For each vector the keys of its bucket and of its probes in each table."""
    n, dim = vectors.shape
    width = max(2, 1 << (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    every, out = np.arange(n), []
    for t in range(tables):
        first, second = [], []
        for _ in range(hashes):
            x = np.zeros((n, width))
            x[:, :dim] = vectors
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(x)
            a = size.argmax(1)
            size[every, a] = -1
            b = size.argmax(1)
            first.append((2 * a + (x[every, a] < 0)).astype(U))
            second.append((2 * b + (x[every, b] < 0)).astype(U))
        for changed in range(-1, hashes):
            key = mix(salt + U(t * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            for h in range(hashes):
                key = mix(key * U(0xD1342543DE82EF95) + (second if h == changed else first)[h] + U(1))
            out.append(key)
    return np.stack(out, 1).view(np.int64)


def _runs_of_length(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length, and places of rows of that length, no more than VALUES components at once."""
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        step = max(1, VALUES // max(1, n))
        for k in range(0, len(mine), step):
            yield n, mine[k : k + step]


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, or none if they can't link, with a digest of the values."""
    for batch in batches:
        lists = batch.column("v")
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        start = np.cumsum(sizes) - sizes
        for size, mine in _runs_of_length(sizes):
            x = flat[start[mine][:, None] + np.arange(size)]
            norm = np.sqrt((x * x).sum(1))
            big = np.abs(x).max(1, initial=0)
            odd = (norm == 0) | ~np.isfinite(norm)
            # squares may leave the range of doubles though the values do not
            again = odd & np.isfinite(big) & (big > 0)
            x[again] /= big[again, None]
            norm[again] = np.sqrt((x[again] ** 2).sum(1))
            good = np.isfinite(norm) & (norm > 0) & np.isfinite(big)
            unit = np.where(good[:, None], x / np.where(good, norm, 1)[:, None], 0)
            bits = (unit + 0.0).view(U).reshape(len(mine), size)
            digest = [mix((bits * (np.arange(1, 2 * size, 2, dtype=U) * U(k) + U(k))).sum(1, dtype=U) + U(size)).view(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            rows = batch.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([rows.column("vec"), rows.column("label"), pa.array([size] * len(mine), pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array([u.tobytes() if g else None for u, g in zip(unit, good.tolist())], pa.binary())], ["vec", "label", "dim", "d1", "d2", "sig"])


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, salt, ids = (batch.column(c).to_numpy() for c in ("dim", "label", "id"))
        for dim, mine in _runs_of_length(dims):
            for part in np.array_split(mine, -(-len(mine) // 2048)):
                x = np.frombuffer(b"".join(batch.column("sig").take(pa.array(part)).to_pylist()), float).reshape(len(part), dim)
                keys = bucket_keys(x, mix(salt[part].view(U) ^ U(dim)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[part], keys.shape[1]))], ["bkey", "id"])


def _linking(least: float):
    """Of two blocks of a group: each vector's number of links to the other block, and a link to the root of its part of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches, ["comp", "x", "y"]):
            blk, x, y = one.column("blk").to_numpy(), one.column("x")[0].as_py(), one.column("y")[0].as_py()
            left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
            if not len(left) or not len(right) or one.num_rows < 2:
                continue
            ids, times = one.column("id").to_numpy(), one.column("times").to_numpy()
            # a group's vectors were found alike, so they have one length and label
            v = np.frombuffer(b"".join(one.column("sig").to_pylist()), float).reshape(one.num_rows, -1)
            linked = (v[left] @ v[right].T >= least) & (ids[left][:, None] != ids[right][None, :])
            a, b = ids[left].copy(), ids[right].copy()
            some = np.iinfo(np.int64).max
            while True:  # least reachable id inside these blocks
                b2 = np.minimum(b, np.where(linked, a[:, None], some).min(0))
                a2 = np.minimum(a, np.where(linked, b2[None, :], some).min(1))
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
            out = [(ids[left], linked @ times[right], a)]
            if x != y:
                out.append((ids[right], linked.T @ times[left], b))
            node, links, root = (np.concatenate([o[k] for o in out]) for k in range(3))
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["id", "links", "root"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row of `vectors`: `id_col, n_links, component_id, kept`.

    Links are pairs with equal non-null labels and a cosine of at least `least`, in double
    precision, that the buckets find; every link is verified.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(F.col(label_col)).alias("label"), F.col(label_col).isNull().alias("bare"))
    usable = F.expr("not bare and v is not null and not exists(v, x -> x is null or isnan(x))")
    read = read.withColumn("v", F.when(usable, F.col("v"))).drop("bare")
    # a row's own number is its node: ids may be shared
    signed = written(read.mapInArrow(_reading, "vec long, label long, dim long, d1 long, d2 long, sig binary").withColumn("id", F.monotonically_increasing_id()), "vectors")
    nodes = signed.where("vec is not null and sig is not null")
    same = ["label", "dim", "d1", "d2"]
    times = nodes.groupBy(*same).agg(F.min(F.struct("vec", "id")).alias("first"), F.count("*").alias("times")).where("times > 1")
    times = written(times.select(*same, F.col("first.id").alias("rep"), F.col("first.vec").alias("rep_vec"), "times"), "copies")
    reps = nodes.join(times, same, "left").where("rep is null or rep = id")
    reps = written(reps.select("id", "vec", "sig", "dim", "label", F.coalesce("times", F.lit(1)).cast("long").alias("times")), "reps")
    rows = reps.select("id", "sig", "dim", "label").mapInArrow(_hashing, "bkey long, id long").distinct()
    like = Likeness("f8", lambda a, b: (a * b).sum(-1), least)
    groups, weight = coarse_groups(rows, reps.select("id", "sig"), like)
    sizes = groups.groupBy("comp").agg(F.count("*").alias("m")).withColumn("nb", F.ceil(F.col("m") / side("m")).cast("int"))
    dealt = groups.join(sizes, "comp").join(reps, "id").withColumn("blk", at("nb")).withColumn("o", every("nb"))
    dealt = dealt.select("comp", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "id", "times", "sig")
    found = dealt.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(_linking(least), "id long, links long, root long")
    found = written(found, "links")

    told = signed.select("id", "vec", *same, F.expr("vec is not null and sig is not null").alias("ok")).join(times.withColumn("ok", F.lit(True)), [*same, "ok"], "left")
    told = written(told.select("vec", "ok", F.coalesce("rep", "id").alias("rep"), "rep_vec", F.coalesce("times", F.lit(1)).alias("times")), "told")
    # rows that share an id are one node
    shared = told.where("vec is not null").groupBy("vec").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b <> other").select("vec", "b")
    shared = told.join(shared, "vec").select(F.col("rep").alias("a"), "b").distinct()
    label = written(connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(shared)), "label")
    label = label.withColumnRenamed("node", "rep")
    named = told.join(label, "rep").groupBy("component").agg(F.min("vec").alias("component_id"))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    counts = written(links.join(label.join(named, "component"), "rep", "full").select("rep", "links", "component_id"), "counts")
    drop(signed, times, reps, weight, found)
    out = told.join(counts, "rep", "left")
    out = out.select(F.col("vec").alias(id_col), F.when(F.col("ok"), F.coalesce("links", F.lit(0)) + F.col("times") - 1).otherwise(0).alias("n_links"), F.coalesce("component_id", "rep_vec", "vec").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
