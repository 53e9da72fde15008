"""Removal of word passages that an earlier document has.

A window is `size` consecutive words of one text. A word goes if a window over it has a word
sequence that also starts in a document with a smaller id.

Documents are dealt to slices of a few MB by a hash of their id. Three passes over the slices:

1. anchors. Every text's non-overlapping blocks of (size + 1) // 2 words are the index, every
   rolling window of so many words is a probe; a shared window holds a whole block of one text at
   a place where the other text's probe meets it. A slice sends each distinct hash once, with two
   bits (some text has it as a block; two texts have it), whatever the number of its copies;
   the owner of a hash range answers which hashes are a block somewhere and in two documents.
2. extension. Windows over an anchor hit are hashed anew, at full length and with 96 bits; a slice
   sends each once, with its smallest id; the owner answers where another slice has a smaller one.
   Runs of neighbouring windows are the maximal exact repeats.
3. removal, from the slice's own smallest ids and those answers.

Hashes of 4 bytes in the first pass can only add candidates. Texts travel as compressed blocks.

What stays keeps its white space; where a removed passage was, one line feed stands if there was one
between the kept words, else one space.

Shapes of input with a defined result: a null, empty or blank text has no words and stays as it is,
as does any text that loses nothing; texts of any length are one document of one slice; a row with a
null id keeps its text and takes part in nothing; rows that share an id are one document whose
windows never remove each other's words (they lie in one slice, so an id must not have very many
rows); of equal windows the one in the document of smallest id stays, wherever it is repeated there;
an empty table gives no rows; other columns are ignored by `substring_dedup` and kept by
`drop_repeats`, whatever their names are.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_batches, lean
from ._runs import runs
from ..scratch import drop, swept, written
from ._rows import nested, opened
from ._words import U, bounds, hashes, mix, slices, texts, windows

#: Bytes of text of a slice, and windows of a hash range, about; both grow with the root of the input up to GROWN times,
#: so that what a slice sends to a range stays worth a row.
SLICE_BYTES, RANGE_KEYS, GROWN = 3 << 20, 1 << 20, 8
_PACK = 16 << 20


def _packing(id_col: str, text_col: str, count: int):
    """Rows of (slice, texts of the slice): ids, byte lengths and compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col, _PACK):
                ids = rows.column(id_col).to_numpy()
                where = _slice_of(ids, count)
                order = np.argsort(where, kind="stable")
                out: dict[str, list] = {"slice": [], "ids": [], "lens": [], "body": []}
                size = np.diff(offsets)
                for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
                    out["slice"].append(int(where[part[0]]))
                    out["ids"].append(ids[part].astype(np.int64).tobytes())
                    out["lens"].append(size[part].astype(np.int64).tobytes())
                    body = b"".join(data[offsets[k] : offsets[k + 1]].tobytes() for k in part.tolist())
                    out["body"].append(zstandard.ZstdCompressor(level=3).compress(body))
                yield pa.RecordBatch.from_arrays([pa.array(out["slice"], pa.int64()), pa.array([0] * len(out["slice"]), pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["lens"], pa.binary()), pa.array(out["body"], pa.binary())], ["slice", "kind", "ids", "lens", "body"])

    return run


_PACKED = "slice long, kind int, ids binary, lens binary, body binary"


def _slice_of(ids: np.ndarray, count: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U) + U(0x632BE59BD9B4E019)) % U(count)).astype(np.int64)


class _Slice:
    """The documents of a slice, by id, with their words."""

    def __init__(self, run: pa.RecordBatch, size: int) -> None:
        rows = [r for r in run.to_pylist() if r["kind"] == 0]
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        lens = np.concatenate([np.frombuffer(r["lens"], np.int64) for r in rows])
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["body"]) for r in rows), np.uint8)
        self.data, self.ids, self.size = data, ids, size
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.starts, self.ends, self.at = bounds(data, self.offsets)
        self.words = hashes(data, self.starts, self.ends)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(ids)), self.count)
        self.place = np.arange(len(self.words)) - np.repeat(self.at[:-1], self.count)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each window inside a text."""
        h = windows(self.words, size, seed)
        inside = np.flatnonzero(self.doc[: len(h)] == self.doc[size - 1 : size - 1 + len(h)])
        return inside, h[inside]


def _groups(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the first place of each group in it."""
    order = np.argsort(order_keys, kind="stable")
    s = order_keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _range_rows(key: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash range of each 64-bit key, and the 4 bytes that stand for it there."""
    return ((key >> U(32)) % U(count)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.uint32)


def _asking(size: int, count: int):
    half = (size + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches, ["slice"]):
            s = _Slice(one, size)
            at, h = s.windows(half)
            if not len(h):
                continue
            order, first = _groups(h)
            block = np.bitwise_or.reduceat((s.place[at[order]] % half == 0).astype(np.uint8), first)
            ids = s.ids[s.doc[at[order]]]
            two = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            bits = block + 2 * two.astype(np.uint8)
            where, short = _range_rows(h[order][first], count)
            order, first = _groups(where)
            last = np.append(first[1:], len(where))
            out = []
            for a, b in zip(first.tolist(), last.tolist()):
                part = order[a:b]
                out.append([int(where[part[0]]), *(short[part[bits[part] == k]].tobytes() for k in range(4))])
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([one.column("slice")[0].as_py()] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["range", "slice", "k0", "k1", "k2", "k3"])

    return run


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each hash range: to each slice, its hashes that are a block somewhere and in two documents."""
    for run in runs(batches, ["range"]):
        keys, bits, owner = [], [], []
        for i in range(run.num_rows):
            for k in range(4):
                got = np.frombuffer(run.column(f"k{k}")[i].as_buffer(), np.uint32)
                keys.append(got)
                bits.append(np.full(len(got), k, np.uint8))
                owner.append(np.full(len(got), i, np.int32))
        key, bit, own = np.concatenate(keys), np.concatenate(bits), np.concatenate(owner)
        order, first = _groups(key)
        size = np.diff(np.append(first, len(key)))
        any_bits = np.bitwise_or.reduceat(bit[order], first)
        good = (any_bits & 1 == 1) & ((size > 1) | (any_bits >= 2))
        picked = order[np.repeat(good, size)]
        which, begin = _groups(own[picked])
        end = np.append(begin[1:], len(picked))
        out = [(run.column("slice")[int(own[picked[which[a]]])].as_py(), key[picked[which[a:b]]].tobytes()) for a, b in zip(begin.tolist(), end.tolist())]
        if out:
            # kind 1 rows carry answers: the range in lens, the hashes in body
            name = np.array([run.column("range")[0].as_py()], np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([b""] * len(out), pa.binary()), pa.array([name] * len(out), pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["slice", "kind", "ids", "lens", "body"])


def _extending(size: int, ranges: int, count: int):
    half = (size + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches, ["slice"]):
            answers = [r for r in one.to_pylist() if r["kind"] == 1]
            if not answers:
                continue
            hit = np.sort(np.concatenate([(U(int(np.frombuffer(r["lens"], np.int64)[0])) << U(32)) | np.frombuffer(r["body"], np.uint32).astype(U) for r in answers]))
            s = _Slice(one, size)
            at, h = s.windows(half)
            where, short = _range_rows(h, ranges)
            probe = (where.astype(U) << U(32)) | short.astype(U)
            near = np.searchsorted(hit, probe)
            found = hit[np.minimum(near, len(hit) - 1)] == probe
            marks = np.zeros(len(s.words) + 1, np.int64)
            marks[at[found] + 1] = 1
            marks = np.cumsum(marks)
            full, one_hash = s.windows(size)
            keep = marks[np.minimum(full + size - half + 1, len(marks) - 1)] - marks[full] > 0
            full, one_hash = full[keep], one_hash[keep]
            if not len(full):
                continue
            two_hash = (windows(s.words, size, 1)[full] >> U(32)).astype(np.uint32)
            ids = s.ids[s.doc[full]]
            order = np.lexsort((ids, two_hash, one_hash))
            a, b = one_hash[order], two_hash[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            a, b, ids = a[first], b[first], ids[order][first]
            where = (a % U(count)).astype(np.int64)
            order, first = _groups(where)
            last = np.append(first[1:], len(where))
            rows = [(int(where[order[x]]), a[order[x:y]].tobytes(), b[order[x:y]].tobytes(), ids[order[x:y]].tobytes()) for x, y in zip(first.tolist(), last.tolist())]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([one.column("slice")[0].as_py()] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["range", "slice", "w1", "w2", "ids"])

    return run


def _settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: to each slice, the windows that another slice has with a smaller id."""
    for run in runs(batches, ["range"]):
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in run.column(name)]  # noqa: E731, B023
        w1s, w2s, idss = read("w1", U), read("w2", np.uint32), read("ids", np.int64)
        own = np.repeat(np.arange(run.num_rows), [len(x) for x in w1s])
        w1, w2, ids = np.concatenate(w1s), np.concatenate(w2s), np.concatenate(idss)
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(first, len(a)))
        least = np.repeat(np.minimum.reduceat(ids[order], first), size)
        later = ids[order] > least
        picked, least = order[later], least[later]
        which, begin = _groups(own[picked])
        end = np.append(begin[1:], len(picked))
        out = []
        for x, y in zip(begin.tolist(), end.tolist()):
            p = which[x:y]
            out.append((run.column("slice")[int(own[picked[p[0]]])].as_py(), w1[picked[p]].tobytes(), w2[picked[p]].tobytes(), least[p].tobytes()))
        if out:
            # kind 2 rows carry smallest ids: 8 bytes of the window in ids, 4 more in lens, the id in body
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([2] * len(out), pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3))], ["slice", "kind", "ids", "lens", "body"])


def _removing(size: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches, ["slice"]):
            s = _Slice(one, size)
            answers = [r for r in one.to_pylist() if r["kind"] == 2]
            full, w1 = s.windows(size)
            gone = np.zeros(len(s.words) + 1, np.int64)
            if len(full):
                w2 = (windows(s.words, size, 1)[full] >> U(32)).astype(np.uint32)
                ids = s.ids[s.doc[full]]
                mine = np.arange(len(full))
                if answers:
                    r1 = np.concatenate([np.frombuffer(r["ids"], U) for r in answers])
                    r2 = np.concatenate([np.frombuffer(r["lens"], np.uint32) for r in answers])
                    rid = np.concatenate([np.frombuffer(r["body"], np.int64) for r in answers])
                    w1, w2, ids = np.concatenate([w1, r1]), np.concatenate([w2, r2]), np.concatenate([ids, rid])
                    mine = np.concatenate([mine, np.full(len(rid), -1)])
                order = np.lexsort((w2, w1))
                a, b = w1[order], w2[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(a))))
                later = mine[order[ids[order] > least]]
                begin = full[later[later >= 0]]
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + size, -1)
            removed = np.cumsum(gone)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(removed)])
            lost = lost[s.at[1:]] - lost[s.at[:-1]]
            body = s.data.tobytes()
            kept = [_rest(body, s.starts[a:b], s.ends[a:b], removed[a:b]) if k else body[x:y] for a, b, k, x, y in zip(s.at[:-1].tolist(), s.at[1:].tolist(), lost.tolist(), s.offsets[:-1].tolist(), s.offsets[1:].tolist())]
            sums = [zlib.crc32(body[a:b]) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(s.count), pa.array(lost), pa.array([x.decode() for x in kept], pa.string()), pa.array(sums, pa.int64())], [id_col, "n_words", "n_removed", "kept_text", "text_crc32"])

    return run


def _rest(body: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> bytes:
    """The kept words of a text with their white space; between two that a removed passage parted, a line feed if there was one, else a space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[1], removed.astype(np.int8), [1]])))
    begin, end = starts[edge[::2]].tolist(), ends[edge[1::2] - 1].tolist()
    out = []
    for k, (x, y) in enumerate(zip(begin, end)):
        if k:
            out.append(b"\n" if body.find(b"\n", end[k - 1], x) >= 0 else b" ")
        out.append(body[x:y])
    return b"".join(out)


def _counting(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            n = [len(t.split()) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), pa.array([t.decode() for t in raw], pa.string()), pa.array([zlib.crc32(t) for t in raw], pa.int64())], [id_col, "n_words", "n_removed", "kept_text", "text_crc32"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """One row per row of `docs`: `id_col`, `n_words`, `n_removed`, `kept_text` (empty for a null text), `text_crc32` (of the whole text).

    Runs jobs that write tables to the shared folder; the last pass is left to the caller.
    """
    with bounded_batches(docs.sparkSession), swept(docs.sparkSession):
        return _deduplicated(docs, id_col, text_col, size)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    read = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    total = read.agg(F.sum(F.octet_length(text_col))).first()
    size_of_all = int(total[0] or 0)
    grown = min(GROWN, max(1.0, (size_of_all / (SLICE_BYTES << 10)) ** 0.5))
    count = max(1, round(size_of_all / (SLICE_BYTES * grown)))
    ranges = max(1, round(size_of_all / 6 / (RANGE_KEYS * grown)))
    named = read.where(F.col(id_col).isNotNull())
    packed = lambda: named.mapInArrow(lean(_packing(id_col, text_col, count)), _PACKED)
    dealt = lambda df, key: df.repartition(key).sortWithinPartitions(key, *(["kind"] if "kind" in df.columns else []))
    asked = dealt(packed(), "slice").mapInArrow(lean(_asking(size, ranges)), "range long, slice long, k0 binary, k1 binary, k2 binary, k3 binary")
    hits = written(dealt(asked, "range").mapInArrow(lean(_answering), _PACKED), "anchors")
    wide = dealt(packed().union(hits), "slice").mapInArrow(lean(_extending(size, ranges, ranges)), "range long, slice long, w1 binary, w2 binary, ids binary")
    least = written(dealt(wide, "range").mapInArrow(lean(_settling), _PACKED), "repeats")
    drop(hits)
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_text string, text_crc32 long"
    out = dealt(packed().union(least), "slice").mapInArrow(lean(_removing(size, id_col, text_col)), schema)
    return out.union(read.where(F.col(id_col).isNull()).mapInArrow(_counting(id_col, text_col), schema))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """`docs` with the same columns and rows; texts that lose words are their `kept_text`, others stay as they are."""
    found = substring_dedup(docs, id_col, text_col, size).where("n_removed > 0")
    with bounded_batches(docs.sparkSession), swept(docs.sparkSession):  # the last pass runs here
        found = written(found.select(F.col(id_col).alias("id"), F.col("text_crc32").alias("crc"), "kept_text").dropDuplicates(["id", "crc"]), "kept")
    rows = nested(docs, id_col, text_col).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    return opened(rows.join(found, ["id", "crc"], "left"), docs.columns, text_col, F.coalesce("kept_text", "text"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest is of the kept words joined by one space."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.btrim(F.regexp_replace("kept_text", r"[ \t\n\x0B\f\r]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
