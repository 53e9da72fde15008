import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspan.llm import packing

PATH = P.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The least number of sequences, by search."""
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= order[i]:
                k = rooms.index(r)
                place(i + 1, rooms[:k] + [r - order[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - order[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    counts = np.bincount(lengths, minlength=13)
    fixed, left = packing.reduce_dominated(counts)
    rest = np.repeat(np.arange(13), left).tolist()
    assert all(sum(p) <= 12 for p, _ in fixed)
    used = np.bincount([s for p, q in fixed for s in p * q], minlength=13)
    assert (used + left == counts).all()
    assert sum(q for _, q in fixed) + fewest(rest, 12) == fewest(lengths, 12)


def check(rows, pieces, capacity=1024):
    tok = Tokenizer.from_file(PATH)
    want, got = [], []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % capacity or capacity
        at = 0
        for k in itertools.count():
            if at >= len(ids):
                break
            want.append((i, k, at, cut - at, zlib.crc32(np.array(ids[at:cut], "<u4").tobytes())))
            at, cut = cut, cut + capacity
    sequences = {}
    for r in pieces:
        got.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(map(str, got)) == sorted(map(str, want))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    made, total = check(rows, packing.op2_best_fit_packing(spark, sf).collect())
    assert made <= -(-total // 1024) + 1


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (3, "x <|endoftext|> y"), (4, "日本 語 🙂"), (5, "ab " * 3000), (6, "é" * 5000), (7, "\x1c a\x85b   c\n\n")]
    rows += [(10 + k, " ".join("word" for _ in range(rng.randrange(40)))) for k in range(50)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, piece string")
    check(rows, packing.pack_tokens(df, PATH).collect())
    check(rows, packing.pack_tokens(df, PATH, capacity=16).collect(), 16)
    assert packing.pack_tokens(df.limit(0), PATH).collect() == []


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(6, 1, 50_000).astype(int) + 1)
    patterns = packing.plan(np.bincount(lengths, minlength=1025))
    assert sum(q for _, q in patterns) <= lengths.sum() / 1024 * 1.002 + 1


def test_plan_does_not_grow_with_the_pieces():
    for many in (20_000, 10**9):
        counts = np.zeros(1025, np.int64)
        counts[[700, 300]] = many
        assert packing.plan(counts) == [((700, 300), many)]
    rng = np.random.default_rng(3)
    for many in (10**3, 10**6, 10**9):
        counts = rng.integers(0, many, 1025)
        counts[0] = 0
        patterns = packing.plan(counts)
        assert len(patterns) < 4 * 1025
        used = np.zeros(1025, np.int64)
        for p, q in patterns:
            assert sum(p) <= 1024 and q > 0
            np.add.at(used, list(p), q)
        assert (used == counts).all()


def test_text_of_more_than_a_mb(spark):
    rng = random.Random(6)
    rows = [(1, " ".join(rng.choice(["word", "Wörter", "don't", "1234", "  x", "été,\n"]) for _ in range(230_000))), (2, "short")]
    assert len(rows[0][1].encode()) > 1 << 20
    check(rows, packing.pack_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())
