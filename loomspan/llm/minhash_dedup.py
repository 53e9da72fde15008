"""Near-duplicate documents by MinHash.

Path of a document: the set of its distinct word shingles; many universal hash minima of the set;
a key for each band of minima; documents that share a band key are candidates; their signatures
are compared, and similar ones put into coarse groups; inside a group links are confirmed on the
full sets; components of the confirmed links come from alternating large-star and small-star.

Equal sets are one node from the start, so a group of copies of any size costs one node. Pairs of
a large group are never listed: each member is compared with the group's centre (the member that
shares most buckets), and only those that the centre does not confirm are compared with the rest
of their group, block against block; blocks grow with the root of the group.

Shapes of input with a defined result: a null, empty or blank text has the empty set and no link; a
text with fewer words than a shingle is one shingle; a very long text is read whole, as any other;
a null id is given back unlinked, with a null component; rows that share an id are one node, linked
with whatever one of them is linked with, and each has its own `n_shingles`; repeated rows are given
back as often; an empty table gives no rows. Other columns are ignored, whatever their names are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_batches, lean
from ._runs import runs
from ..scratch import drop, written
from ._words import BYTE, BYTE_LOWER, U, bounds, hashes, mix, slices, windows
from .buckets import Likeness, at, coarse_groups, every, side
from .components import Joined, connected_components

#: Minima of a signature, and minima of a band. A pair of similarity 0.8 misses all 32 bands once in 300,000 times.
MINIMA, ROWS = 160, 5
#: Members of a group that meet one copy of its centre, and shingles of a block's sets, about.
SHARE, BLOCK_GRAMS = 256, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, at = bounds(data, offsets)
    words = hashes(data, starts, ends, BYTE_LOWER if lower else BYTE)
    grams = windows(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a, seed=b - a))
        else:
            out.append(words[:0])
    return out


def minima(sets: list[np.ndarray], count: int = MINIMA, seed: int = 1) -> np.ndarray:
    """For each non-empty set the minima under `count` multiply-add-shift hash functions, 16 bits of each."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 2**63, (2, count), dtype=U) * U(2) + U(1)
    values = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((count, len(sets)), np.uint16)
    for k in range(count):
        out[k] = np.minimum.reduceat((values * a[k] + b[k]) >> U(24), first) & U(0xFFFF)
    return np.ascontiguousarray(out.T)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, count = signatures.shape
    bands = signatures.reshape(n, count // rows, rows).astype(U)
    keys = np.broadcast_to(np.arange(count // rows, dtype=U) * U(0x9E3779B97F4A7C15), bands.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * U(0xD1342543DE82EF95) + bands[:, :, k] + U(1))
    return keys.view(np.int64)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128 bits of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(n)
    out = np.zeros((2, len(sets)), U)
    if len(some):
        values = np.concatenate([sets[i] for i in some])
        first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
            out[k, some] = np.add.reduceat(mix(values ^ U(salt)), first)
    return n, out[0].view(np.int64), out[1].view(np.int64)


def _signing(size: int, lower: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = shingle_sets(data, offsets, size, lower)
                n, one, two = _digests(sets)
                some = np.flatnonzero(n)
                signed: list = [None] * len(sets)
                if len(some):
                    for i, s in zip(some.tolist(), minima([sets[i] for i in some])):
                        signed[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(n), pa.array(one), pa.array(two), pa.array(signed, pa.binary())], ["doc", "n", "d1", "d2", "sig"])

    return sign


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _banding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1]))], ["bkey", "id"])


def _setting(size: int, lower: bool):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = shingle_sets(data, offsets, size, lower)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([rows.column("doc"), *map(pa.array, _digests(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["doc", "n", "d1", "d2", "grams"])

    return out


def _confirming(percent: int, least: int):
    """Inside a group: unconfirmed members (side 0) against members (side 1), on full sets."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["comp", "x", "y"]):
            side = run.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            ids, fine, n = (run.column(c).to_numpy() for c in ("id", "fine", "n"))
            sig, grams = _matrix(run.column("sig")), run.column("grams")
            sets = [np.asarray(grams[i].values).view(U) for i in range(run.num_rows)]
            a, b, joined = [], [], Joined()
            for i in left.tolist():
                may = (fine[right] != fine[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
                # a pair of unconfirmed members is met twice, as (i, j) and (j, i): once is enough
                may &= (fine[right] != ids[right]) | (ids[right] < ids[i])
                o = right[may]
                o = o[(sig[o] == sig[i]).sum(1) >= least] if len(o) else o
                for j in o.tolist():
                    # what links of this block already join need not be compared
                    if joined.root(int(fine[i])) == joined.root(int(fine[j])):
                        continue
                    s, t = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                    place = np.searchsorted(t, s)
                    both = int((t[np.minimum(place, len(t) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        joined.join(int(fine[i]), int(fine[j]))
                        a.append(ids[i])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keep


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row per row of `docs`: `id_col`, `n_shingles`, `component_id`, `kept`.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `shingle`-word
    shingles; `component_id` is the smallest id that a document reaches over links, `kept` says
    that it is its own. Texts are read whole and no group is capped. Intermediate tables go to the
    shared folder; the function runs jobs and returns a frame over those tables.
    """
    with bounded_batches(docs.sparkSession):
        return _deduplicated(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), shingle, percent, lower).withColumnRenamed("doc", id_col)


def _deduplicated(read: DataFrame, shingle: int, percent: int, lower: bool) -> DataFrame:
    signed = read.mapInArrow(lean(_signing(shingle, lower)), "doc long, n long, d1 long, d2 long, sig binary").withColumn("id", F.monotonically_increasing_id())
    signed = written(signed, "signed")
    # a document's id is its node; where rows share ids, a row's own number is
    clash = bool(signed.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").take(1))
    made, signed = signed, signed if clash else signed.withColumn("id", F.col("doc"))
    least = max(1, round(MINIMA * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / MINIMA) ** 0.5)))
    nodes = signed.where("doc is not null and n > 0")
    digest = ["n", "d1", "d2"]
    same = nodes.groupBy(*digest).agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("copies"))
    same = written(same.where("copies > 1").select(*digest, F.col("first.id").alias("rep"), F.col("first.doc").alias("rep_doc")), "copies")  # a table, so that a skewed join with it can be split
    reps = written(nodes.join(same, digest, "left").where("rep is null or rep = id").select("id", "doc", *digest, "sig"), "reps")

    # coarse groups by signature
    sigs = reps.select("id", "sig")
    rows = sigs.mapInArrow(_banding, "bkey long, id long")
    coarse, weight = coarse_groups(rows, sigs, Likeness("u2", lambda a, b: (a == b).sum(-1), least))

    # links on full sets
    top = coarse.join(weight, "id", "left").groupBy("comp").agg(F.max(F.struct(F.coalesce("w", F.lit(0)), (-F.col("id")).alias("neg"))).alias("top"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    top = written(top.select("comp", (-F.col("top.neg")).alias("centre"), "shares"), "top")
    groups = written(coarse.join(top, "comp"), "groups")
    # the texts of these rows alone are read again: their ids are in a narrow table, so that its size tells how to join
    asked = written(groups.join(reps.select("id", "doc"), "id").select("doc").distinct(), "asked") if clash else groups.select(F.col("id").alias("doc"))
    sets = read.join(asked, "doc", "left_semi").mapInArrow(lean(_setting(shingle, lower)), "doc long, n long, d1 long, d2 long, grams array<long>")
    full = written(groups.join(reps, "id").join(sets, ["doc", *digest]).dropDuplicates(["doc", *digest]), "full")
    # a centre is repeated for every SHARE members, so that no task meets more of them
    mid = full.where("id = centre").select("centre", every("shares").alias("share"), F.col("grams").alias("cgrams"), F.col("n").alias("cn"))
    both = F.size(F.array_intersect("grams", "cgrams"))
    near = full.where("id <> centre").select("id", "centre", at("shares").alias("share"), "grams", "n").join(mid, ["centre", "share"]).where(100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))
    near = written(near.where(100 * both >= percent * (F.col("n") + F.col("cn") - both)).select(F.col("id").alias("a"), F.col("centre").alias("b")), "near")

    known = full.join(near.select(F.col("a").alias("id"), F.lit(True).alias("ok")), "id", "left").withColumn("fine", F.when(F.expr("ok or id = centre"), F.col("centre")).otherwise(F.col("id")))
    count = known.groupBy("comp").agg(F.count("*").alias("m"), F.avg("n").alias("mean"), F.sum(F.when(F.expr("ok is null and id <> centre"), 1).otherwise(0)).alias("out")).where("out > 0 and m > 2")
    size = F.greatest(F.lit(1.0), F.least(side("m"), BLOCK_GRAMS / F.col("mean")))
    known = known.join(count, "comp").withColumn("nx", F.ceil(F.col("out") / size).cast("int")).withColumn("ny", F.ceil(F.col("m") / size).cast("int"))
    cols = ["comp", "x", "y", "side", "id", "fine", "n", "sig", "grams"]
    ones = known.where("ok is null and id <> centre").withColumn("side", F.lit(0)).withColumn("x", at("nx")).withColumn("y", every("ny"))
    others = known.where("id <> centre").withColumn("side", F.lit(1)).withColumn("y", at("ny")).withColumn("x", every("nx"))
    last = ones.select(cols).union(others.select(cols)).repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    links = near.union(last.mapInArrow(lean(_confirming(percent, least)), "a long, b long"))

    told = signed.select("id", "doc", *digest).join(same, digest, "left")
    told = told.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "id")).alias("rep"), F.when(F.col("doc").isNotNull(), F.col("rep_doc")).alias("rep_doc"))
    if clash:
        told, label = _named(written(told, "told"), links)
    else:
        label = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    out = told.join(label, "rep", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep_doc", "doc").alias("component_id"))
    drop(reps, weight, top, groups, full, *([asked, made, same] if clash else []))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))


def _named(told: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`told`, and for each linked node `rep` its `component_id`, where rows that share an id are one node and nodes are numbers of rows."""
    shared = told.where("doc is not null").groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b <> other").select("doc", "b")
    shared = told.join(shared, "doc").select(F.col("rep").alias("a"), "b").distinct()
    label = connected_components(links.union(shared)).withColumnRenamed("node", "rep")
    # the least id of a component, copies of its nodes included
    named = told.join(label, "rep").groupBy("component").agg(F.min("doc").alias("component_id"))
    return told, written(label.join(named, "component").select("rep", "component_id"), "label")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)
