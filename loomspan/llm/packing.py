"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length is needed to plan: a histogram of at most `capacity`
counts, whatever the number of documents; the plan has a few patterns for each length. The plan is a list of patterns (how many pieces of which
lengths share a sequence) with multiplicities, and every piece finds its place in it from its
length and its rank among the pieces of that length. Ranks come from counts of chunks, so nothing
but the histogram is collected.

Reduction, from the longest length down: a piece that nothing fits beside is fixed alone; a piece
whose largest companion fills the sequence exactly, or beats any set of two or more companions
together, is fixed with it, as that set dominates all others that hold the piece. This goes on
until nothing changes; what remains is packed best-fit decreasing.

Shapes of input with a defined result: a null or empty text is the end token alone; a text of any
length is tokenised whole and cut into pieces; null or repeated ids are packed and given back like
others; pieces of equal length are taken in the order of the table's parts, which any run may change
without changing the number of sequences; an empty table gives no rows; other columns are ignored,
whatever their names are.
"""

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import written
from ._batches import bounded_batches, lean
from ._words import SLICE, texts
from .tokens import _two, shipped

_END_MARK = "<|endoftext|>"


def reduce_dominated(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns that dominance fixes, with multiplicities, and the counts that remain.

    counts[l] is the number of pieces of length l; the capacity is len(counts) - 1.
    """
    left, capacity, fixed = counts.copy(), len(counts) - 1, []
    if left[capacity]:
        fixed.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    changed = True
    while changed:
        changed = False
        for s in np.flatnonzero(left)[::-1].tolist():
            while left[s]:
                gap = capacity - s
                left[s] -= 1
                there = np.flatnonzero(left[: gap + 1])
                left[s] += 1
                if not len(there):
                    # nothing fits beside it, so it is alone; if others of its length could join, `there` has them
                    fixed.append(((s,), int(left[s])))
                    left[s] = 0
                    changed = True
                    break
                k = int(there[-1])
                if k != gap and _best_of_many(left, s, there, gap) > k:
                    break
                # the reason holds for as long as there are both: pieces only go, so no set of others grows
                n = int(left[s]) // 2 if k == s else int(min(left[s], left[k]))
                fixed.append(((s, k), n))
                left[s] -= n
                left[k] -= n
                changed = True
    return fixed, left


def _best_of_many(left: np.ndarray, s: int, there: np.ndarray, gap: int) -> int:
    """At least the largest sum within the gap of two or more pieces beside one of length s; 0 if none fits."""
    least = int(there[0])
    second = least if left[least] - (least == s) > 1 else int(there[1]) if len(there) > 1 else gap + 1
    if least + second > gap:
        return 0
    sums, mask = 0, (1 << (gap + 1)) - 1
    for size in there.tolist():
        sums |= 1 << size
    reach, best = sums, 0
    while True:
        more = 0
        for size in there.tolist():
            more |= reach << size
        more &= mask
        if not more:
            return best
        best = max(best, more.bit_length() - 1)
        if best == gap or more | reach == reach:
            return best
        reach |= more


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: patterns with multiplicities."""
    capacity = len(counts) - 1
    open_: dict[int, list[list]] = {}  # room left: [pattern, number of sequences]
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        for room in sorted(r for r in open_ if r >= s):
            if not n:
                break
            # a sequence stays the best fit while it has room for another piece of this length
            each = room // s
            groups, rest = open_.pop(room), []
            for pattern, q in groups:
                full = min(q, n // each)
                if full:
                    open_.setdefault(room - each * s, []).append([pattern + (s,) * each, full])
                    n -= full * each
                    q -= full
                if q and n:
                    open_.setdefault(room - n * s, []).append([pattern + (s,) * n, 1])
                    q, n = q - 1, 0
                if q:
                    rest.append([pattern, q])
            if rest:
                open_.setdefault(room, []).extend(rest)
        if n:
            each = capacity // s
            if n // each:
                open_.setdefault(capacity - each * s, []).append([(s,) * each, n // each])
            if n % each:
                open_.setdefault(capacity - n % each * s, []).append([(s,) * (n % each), 1])
    return [(p, q) for groups in open_.values() for p, q in groups]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """All patterns with multiplicities for a histogram of lengths."""
    fixed, left = reduce_dominated(counts)
    return fixed + best_fit(left)


def runs_of_ranks(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length its ranks in order of the patterns: where a run starts, its first sequence, pieces a sequence and first offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, q in patterns:
        offset, i = 0, 0
        while i < len(pattern):
            s, c = pattern[i], 1
            while i + c < len(pattern) and pattern[i + c] == s:
                c += 1
            start = taken.get(s, 0)
            rows.append((s, start, sequence, c, offset))
            taken[s] = start + c * q
            offset += c * s
            i += c
        sequence += q
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) | table[:, 1], "start": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _fast(path: str):
    """The same vocabulary by the faster library, for texts on whose characters both agree."""
    import json

    import tiktoken

    with open(path) as f:
        model = json.load(f)
    if model["normalizer"] or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token != _END_MARK}
    merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
    order = [model["model"]["vocab"][a + b] for a, b in merged]
    if order != sorted(order):
        return None
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # Fixed value: the published pattern of this kind of pre-tokenizer.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocab, special_tokens=special)


def token_ids(path: str, data: np.ndarray) -> np.ndarray:
    """The ids of one text. Characters from U+3000 on and very long texts take the slower library."""
    if not len(data):
        return np.zeros(0, np.uint32)
    fast = _fast(path)
    text = data.tobytes().decode()
    if fast is None or len(data) > SLICE or data.max() >= 0xE3:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode(text, allowed_special="all"), np.uint32)


def _cutting(place, id_col: str, text_col: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, chunk = place(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(text_col))
            owner, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                ids = np.append(token_ids(path, data[a:b]), np.uint32(end)).astype("<u4")
                at, cut = 0, len(ids) % capacity or capacity
                while at < len(ids):
                    owner.append(k)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at)
                    length.append(cut - at)
                    crc.append(zlib.crc32(ids[at:cut].tobytes()))
                    rank.append(int(seen[cut - at]))
                    seen[cut - at] += 1
                    at, cut = cut, cut + capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([chunk] * len(owner), pa.int64()), pa.array(rank, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32", "chunk", "k"],
            )

    return run


def _placing(table: dict[str, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(table["key"], (length << 48) | rank, "right") - 1
            nth = rank - table["start"][at]
            each = table["each"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(table["sequence"][at] + nth // each), pa.array(table["offset"][at] + nth % each * length)], [*names, "sequence_id", "offset"])

    return run


def pack_tokens(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: `id_col, piece, start, length, ids_crc32, sequence_id, offset`.

    A document is its ids by the tokenizers file at `path`, then `end`; longer ones than `capacity`
    are cut from their end, so that only the first piece is shorter.
    """
    place = shipped(docs, path)
    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, chunk long, k long"
    with bounded_batches(docs.sparkSession):
        pieces = written(_two(docs, id_col, text_col).mapInArrow(lean(_cutting(place, id_col, text_col, capacity, end)), schema), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    table = runs_of_ranks(plan(histogram))
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(base, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("k"))
    return ranked.select(*names, "rank").mapInArrow(_placing(table, names), f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
