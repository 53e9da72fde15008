"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the n-grams of every training text are summed per language in one pass, in matrices of a
fixed size; the log-probability matrix (BUCKETS x languages, a few MB) goes to the executors, and a
batch of texts is scored by gathering the rows of its n-grams and summing them for each text.

Any number of languages is learned: their counts are gathered and sent in blocks of LANGUAGES, each a
matrix of a fixed size, and a text is scored by one block after the other.

Shapes of input with a defined result: a null or empty text, or one without a letter, is `und` with
score 0; texts of any length are read whole, in runs of about a MB; training leaves out null ids, null
texts and null languages; without any training text every text is `und`; of languages with equal
scores the first by name is taken; null or repeated ids are given back as they are, repeated texts
train as often as they come; an empty table gives no rows; other columns are ignored, whatever their
names are.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written
from ._words import U, mix, slices

#: Columns of the matrix, sizes of the n-grams (in characters), languages of a block.
BUCKETS, SIZES, LANGUAGES = 1 << 16, (1, 2, 3), 32
UNKNOWN = "und"


def _letters(top: int = 0x110000) -> np.ndarray:
    table = np.zeros(top, bool)
    table[[c for c in range(top) if chr(c).isalpha()]] = True
    return table


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _TABLES:
        _TABLES["letter"] = _letters()
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c) != (low := chr(c).lower()) and len(low) == 1:
                lower[c] = ord(low)
        _TABLES["lower"] = lower
    return _TABLES[name]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with a letter of each text, the text of each, and whether a text has a letter.

    Characters are lower-cased, others than letters count as one space; an n-gram lies in one text.
    """
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum(lead)])
    at = before[offsets]
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    letter = _table("letter")[points]
    code = np.where(letter, _table("lower")[points], 32).astype(np.uint32)
    has = np.bincount(doc[letter], minlength=n) > 0
    # a run of other characters counts as one space
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    code, doc = code[keep], doc[keep]
    found, owner = [], []
    for size in SIZES:
        m = len(code) - size + 1
        if m <= 0:
            continue
        h = np.full(m, size, np.uint64)
        some = np.zeros(m, bool)
        for k in range(size):
            h = h * U(0x9E3779B97F4A7C15) + code[k : k + m].astype(U)
            some |= code[k : k + m] != 32
        inside = some & (doc[:m] == doc[size - 1 : size - 1 + m])
        found.append((mix(h[inside]) & U(BUCKETS - 1)).astype(np.int32))
        owner.append(doc[:m][inside])
    return (np.concatenate(found), np.concatenate(owner), has) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), has)


def held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 4, is 2; a null id is held out."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], bool)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[np.ndarray]]:
    """Languages in order, and for each block of them the float32 matrix (BUCKETS + 1, languages) of log probabilities, the last row being the priors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], docs_of[name]), pa.int64())], ["lang", "bucket", "n"])
            sums.clear()
            docs_of.clear()

        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                langs = np.array(rows.column("lang").to_pylist(), object)
                bucket, owner, _ = grams(data, offsets)
                for name in set(langs):
                    mine = langs == name
                    sums[name] = sums.get(name, 0) + np.bincount(bucket[mine[owner]], minlength=BUCKETS)
                    docs_of[name] = docs_of.get(name, 0) + int(mine.sum())
                    if len(sums) > 2 * LANGUAGES:
                        yield from told()
        yield from told()

    learn = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    learn = learn.where("lang is not null and text is not null and id is not null and crc32(cast(id as binary)) % 4 <> 2").select("lang", "text")
    counts = written(learn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    documents = counts.where("bucket = -1").toPandas()  # a row for each language
    names = sorted(documents["lang"])
    every = documents["n"].sum() + len(names)
    blocks = []
    for k in range(0, len(names), LANGUAGES):
        block = {x: j for j, x in enumerate(names[k : k + LANGUAGES])}
        rows = counts.where(F.col("lang").isin(list(block))).toPandas()  # at most LANGUAGES * (BUCKETS + 1) rows
        n = np.zeros((BUCKETS + 1, len(block)))
        n[rows["bucket"].to_numpy(), rows["lang"].map(block).to_numpy(int)] = rows["n"].to_numpy()
        total = n[:BUCKETS] + 0.5
        blocks.append(np.vstack([np.log(total / total.sum(0)), np.log((n[BUCKETS:] + 1) / every)]).astype(np.float32))
    drop(counts)
    return names, blocks


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: `id_col, held_out, lang_pred, score`, learnt from the rows that are not held out.

    `score` is the posterior of the predicted language with the text's evidence per character
    n-gram spread over twenty of them, so that it tells sure from doubtful texts at any length.
    """
    names, blocks = train(docs, id_col, text_col, lang_col)
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priors = np.concatenate([b.value[BUCKETS] for b in sent]) if sent else None
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                n = rows.num_rows
                bucket, owner, has = grams(data, offsets)
                total, k = np.empty((n, len(names))), 0
                for b in sent:
                    for column in range(b.value.shape[1]):
                        total[:, k] = np.bincount(owner, b.value[bucket, column], n)
                        k += 1
                size = np.maximum(np.bincount(owner, minlength=n), 1)
                if names:
                    best = (total + priors).argmax(1)
                    mean = 20 * total / size[:, None] + priors
                    mean = np.exp(mean - mean.max(1, keepdims=True))
                    score = np.where(has, mean[np.arange(n), best] / mean.sum(1), 0.0)
                    said = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                else:
                    score, said = np.zeros(n), [UNKNOWN] * n
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(held_out(rows.column("id").to_pylist())), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
