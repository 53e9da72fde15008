import random
import re

import duckdb

from loomspan.llm.minhash_dedup import minhash_dedup, op1_minhash_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        g = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[i] = g
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def got(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert got(op1_minhash_dedup(spark, sf)) == brute(rows, 2, 80)


def test_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
        rows.append((i * 7 % 1009, " ".join(w).upper() if i % 3 else " ".join(w)))
    rows += [(5000 + i, "same  text here\n") for i in range(50)] + [(6000 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(40))) for i in range(60)]
    assert got(minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)) == brute(rows, 2, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "É one"), (7, "é one"), (8, "a b c d e f g " * 3000), (9, "a b c d e f g " * 2999)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    assert got(minhash_dedup(df)) == brute(rows, 5, 80)
    nulls = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert got(minhash_dedup(nulls, shingle=2)) == {(None, 2, None, True), (3, 2, 3, True), (4, 2, 3, False)}


def test_shared_ids_are_one_node(spark):
    rng = random.Random(8)
    p, q = ([f"{k}{rng.randrange(900)}" for _ in range(30)] for k in "pq")
    rows = [(1, p), (1, q), (2, [*p, "x"]), (3, [*q, "y"]), (4, ["other", "text"]), (5, p), (5, ["lone", "words"]), (6, ["lone", "words"]), (6, []), (7, []), (7, ["other", "text", "longer"])]
    rows += [(9, [*q, "z"]), (8, ["lone", "words", "more", "of", "them"]), (8, ["lone", "words"])]
    table = [(i, " ".join(w)) for i, w in rows]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1, 7: 7, 8: 1, 9: 1}
    for parts in (1, 3):
        df = spark.createDataFrame(table, "doc_id long, text string").repartition(parts)
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup(df, shingle=2).collect()} == {(i, c, i == c) for i, c in want.items()}


def test_names_that_clash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.selectExpr("*", "1 as `a.b`", "2 as id", "3 as doc", "4 as n", "5 as component", "6 as n_shingles")
    assert got(minhash_dedup(odd)) == got(minhash_dedup(docs))


def test_empty_table(spark):
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
