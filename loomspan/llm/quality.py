"""Quality rules: an isolation forest over rule statistics of each document.

One pass over the texts gives each document's counts (words, symbols, repeated lines and windows,
capitals, ...). A forest of random splits is grown on a bounded sample of the labelled documents; a
document that few splits set apart from the rest is anomalous. The threshold on that score is set
from all other labelled documents, none of which the forest has seen: the one that finds most of
the bad ones while it loses at most a given share of the good ones. Every document is scored.

The trees grow on the good documents of the sample, as a region that they leave empty is a leaf at
once. Grown on all of its rows whatever their label, a forest that may lose 0.2 % of the good
labelled documents mostly found less than half of the bad ones, as junk comes in clusters that
random splits do not isolate; grown on good ones it found 98 % or more.

Shapes of input with a defined result: a null, empty or blank text has no words and fails the base
rule; a text of any length is read whole, in runs of about a MB; labels may be missing, null or
repeated (a repeated label, or an id that several documents share, counts once for each pair of
them); without any good label the verdict is the base rule alone; documents with equal statistics
get equal scores, and a score at the threshold is rejected; repeated documents are judged each by
itself; a null id is given back with its verdict but has no label; an empty table gives no rows;
other columns are ignored by `quality_rules` and kept by `keep_quality`, whatever their names are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import drop, written
from ._batches import bounded_batches, give_back
from ._rows import nested, opened, quoted
from ._words import U, bounds, hashes, mix, slices, windows

#: Bounds of the labelled sample that the forest is grown on, of the rows a tree sees, and of trees.
SAMPLE, TREE_ROWS, TREES = 20_000, 256, 128
#: Steps of the scores from which the threshold is read.
BINS = 1 << 14
#: Texts with fewer words fail the base rule; their ratios say little.
MIN_WORDS = 50
#: The share of good labelled documents that the threshold may lose.
LOST = 0.002
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_letters"]
FEATURES = ["symbols", "upper", "marks", "repeats", "distinct", "symbols_or_marks"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&|<>")] = 1
_CLASS[65:91] = 2
_CLASS[list(b"!?{}[]=~^_\\/@+")] = 4
_CLASS[97:123] = 5


def _per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marked elements each text has; text k has the elements at[k] to at[k + 1]."""
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[at[1:]] - sums[at[:-1]]


def _own(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(values ^ mix(owner.astype(U) + U(0x3C6EF372FE94F82B)))


def rule_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(offsets) - 1
    starts, ends, at = bounds(data, offsets)
    words = hashes(data, starts, ends)
    count = np.diff(at)
    doc = np.repeat(np.arange(n), count)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead & (np.cumsum(inside[:-1]) > 0))]) if len(data) else np.zeros(1, np.int64)
    kind = _CLASS[data]

    w = _own(words, doc)
    _, first = np.unique(w, return_index=True)
    new = np.zeros(len(w), bool)
    new[first] = True

    grams = windows(words, 3)
    within = np.flatnonzero(doc[: len(grams)] == doc[2 : 2 + len(grams)])
    _, back, times = np.unique(_own(grams[within], doc[within]), return_inverse=True, return_counts=True)
    begin = within[times[back] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    cover[begin] += 1
    cover[begin + 3] -= 1
    repeated = np.cumsum(cover)[:-1] > 0

    # lines: runs between line feeds and text ends
    cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], cut + 1])) if len(data) else offsets[:0]
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = np.where(data[line_end - 1] == 10, line_end - 1, line_end) if len(line_start) else line_end
    first_word = np.searchsorted(starts, line_start)
    has = (first_word < len(starts)) & (np.append(starts, len(data) + 1)[first_word] < line_end)
    line_start, line_end = line_start[has], line_end[has]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    lines = _own(hashes(data, line_start, line_end), line_doc)
    _, first = np.unique(lines, return_index=True)
    fresh = np.zeros(len(lines), bool)
    fresh[first] = True

    return {
        "n_words": count,
        "word_chars": points[offsets[1:]] - points[offsets[:-1]],
        "n_symbols": _per_text(kind == 1, offsets),
        "n_dup_lines": np.bincount(line_doc[~fresh], minlength=n),
        "n_repeat_words": _per_text(repeated, at),
        "n_upper": _per_text(kind == 2, offsets),
        "n_marks": _per_text(kind == 4, offsets),
        "n_distinct": _per_text(new, at),
        "n_letters": _per_text((kind == 2) | (kind == 5), offsets),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each document, from its counts."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.column_stack([
        c["n_symbols"] / chars,
        c["n_upper"] / letters,
        c["n_marks"] / chars,
        c["n_repeat_words"] / words,
        c["n_distinct"] / words**0.85,  # the share of distinct words falls with length in any text
        (c["n_symbols"] + c["n_marks"]) / words,
    ])


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = 10, seed: int = 7) -> dict[str, np.ndarray]:
    """An isolation forest as arrays: for each tree and heap-numbered node its feature, split and path length.

    `rows` are ordinary documents; splits are drawn uniformly over what is left of the range `low`
    to `high`, which other documents may reach: a side without rows is a leaf at once, so whatever
    falls there has a short path.
    """
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.zeros((trees, nodes), np.int8), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: (rows[rng.choice(len(rows), size, replace=False)], low, high)}
        for node in range(nodes):
            level = (node + 1).bit_length() - 1
            if node not in held:
                # below a leaf: the leaf's length
                path[t, node] = path[t, (node - 1) // 2]
                continue
            part, lo, hi = held.pop(node)
            path[t, node] = level + _average_path(np.array([len(part)]))[0]
            may = np.flatnonzero(hi > lo)
            if level == depth or not len(part) or not len(may):
                continue
            f = int(rng.choice(may))
            s = rng.uniform(lo[f], hi[f])
            left = part[:, f] < s
            feature[t, node], split[t, node] = f, s
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[f] = lo2[f] = s
            held[2 * node + 1], held[2 * node + 2] = (part[left], lo, hi2), (part[~left], lo2, hi)
    return {"feature": feature, "split": split, "path": path, "norm": _average_path(np.array([size])), "depth": np.array([depth])}


def anomaly(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / its average): near 1 for rows that few splits set apart."""
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for feature, split, path in zip(forest["feature"], forest["split"], forest["path"]):
        node = np.zeros(len(rows), np.int64)
        for _ in range(int(forest["depth"][0])):
            node = 2 * node + 1 + (rows[every, feature[node]] >= split[node])
        total += path[node]
    return 2.0 ** -(total / len(forest["path"]) / max(float(forest["norm"][0]), 1e-9))


def threshold(good: np.ndarray, bad: np.ndarray, lost: float = LOST) -> float:
    """The score at and above which documents go, from the number of good and of bad ones in each of equal steps from 0 to 1.

    No more than the share `lost` of the good ones lie above it; it stands half-way to the least
    bad one there, and is infinite where there is none.
    """
    above = np.cumsum(good[::-1])[::-1]
    over = np.flatnonzero(above > int(lost * good.sum()))
    if not len(over):
        return np.inf
    edge = over[-1] + 1
    found = np.flatnonzero(bad[edge:])
    return float((edge + found[0] / 2) / len(good)) if len(found) else np.inf


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than MIN_WORDS words, or more than half of them in repeated windows."""
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _counted(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy() for k in COUNTS}


_STRUCT = pa.struct([(k, pa.int64()) for k in COUNTS])


@F.arrow_udf(StructType([StructField(k, LongType()) for k in COUNTS]))
def _counts_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        parts = [rule_statistics(data, offsets) for _, data, offsets in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in COUNTS], fields=list(_STRUCT))
    give_back()


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """A written table of `id` and the COUNTS of each row, from one pass over the texts; with `rows` also each whole row as a struct `row`.

    Only texts go through Python.
    """
    with bounded_batches(docs.sparkSession):
        read = nested(docs, id_col, text_col) if rows else nested(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col)
        counted = read.withColumn("counts", _counts_of("text"))
        return written(counted.select(*(["row"] if rows else []), "id", "counts.*"), "counts")


def fit(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, lost: float = LOST) -> tuple[dict[str, np.ndarray] | None, float]:
    """The forest and its threshold, from `counts` of all documents and labels.

    Labelled ids are halved by a hash. The forest is grown on the good documents among at most
    `sample` rows of one half (those of least hash); the threshold comes from a histogram of the
    scores of all rows of the other half.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("int") > 0).alias("good")).where("id is not null and good is not null")
    told = written(counts.select("id", *COUNTS).join(told, "id").withColumn("h", F.xxhash64("id", F.lit(17))), "labelled")
    drawn = told.where("h % 2 = 0").orderBy("h", "id", "good", *COUNTS).limit(sample).toPandas()
    c = {k: drawn[k].to_numpy() for k in COUNTS}
    ok, good = ~base_failed(c), drawn["good"].to_numpy(bool)
    rows = features(c)
    forest = grow(rows[ok & good], rows[ok].min(0), rows[ok].max(0)) if (ok & good).any() else None
    if forest is None:
        drop(told)
        return None, np.inf

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _counted(batch)
            keep = ~base_failed(c)
            bins = np.minimum((anomaly(forest, features(c)) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("good").filter(pa.array(keep)), pa.array(bins[keep])], ["good", "bin"])

    seen = told.where("h % 2 <> 0").mapInArrow(binned, "good boolean, bin int").groupBy("good", "bin").agg(F.count("*").alias("n")).toPandas()  # at most 2 * BINS rows
    drop(told)
    sides = [np.bincount(x["bin"].to_numpy(int), x["n"].to_numpy(float), BINS).astype(np.int64) for x in (seen[seen["good"]], seen[~seen["good"].astype(bool)])]
    return forest, threshold(*sides, lost)


def _judge(c: dict[str, np.ndarray], forest: dict | None, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(c)
    score = anomaly(forest, features(c)) if forest else np.zeros(len(failed))
    return failed, score, ~failed & ~(score >= edge)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of `docs`: `id_col`, the COUNTS, `base_failed`, `anomaly` and `kept`."""
    counts = document_counts(docs, id_col, text_col)
    forest, edge = fit(counts, labels, id_col, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, score, kept = _judge(_counted(batch), forest, edge)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], ["id", *COUNTS, "base_failed", "anomaly", "kept"])

    out = counts.mapInArrow(run, "id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_short: bool = False, **settings) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    The rows are written once with their counts, so that texts are looked at once.
    `keep_short`: texts of one word up to MIN_WORDS, whose ratios say little, stay.
    """
    counts = document_counts(docs, id_col, text_col, rows=True)
    forest, edge = fit(counts, labels, id_col, **settings)

    @F.arrow_udf("boolean")
    def kept(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column in columns:
            c = {k: v.to_numpy() for k, v in zip(COUNTS, column)}
            yield pa.array(_judge(c, forest, edge)[2] | (keep_short & (c["n_words"] > 0) & (c["n_words"] < MIN_WORDS)))

    return opened(counts.where(kept(*COUNTS)), docs.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return quality_rules(read("documents"), read("labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
