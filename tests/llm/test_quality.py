import re
from collections import Counter

import duckdb
import numpy as np

from loomspan.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r[0]: r for r in quality.op7_quality_rules(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert tuple(got[i][1:6]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def plain_features(t):
    n, chars, symbols, _, repeat = brute(t)
    letters, upper = len(re.findall("[A-Za-z]", t or "")), len(re.findall("[A-Z]", t or ""))
    marks, kinds = len(re.findall(r"[!?{}\[\]=~^_\\/@+]", t or "")), len(set(WORD.findall(t or "")))
    words, chars, letters = max(n, 1), max(chars, 1), max(letters, 1)
    return [symbols / chars, upper / letters, marks / chars, repeat / words, kinds / words**0.85, (symbols + marks) / words]


def plain_score(forest, row):
    total = 0.0
    for feature, split, path in zip(forest["feature"], forest["split"], forest["path"]):
        node = 0
        while 2 * node + 2 < len(split) and np.isfinite(split[node]):
            node = 2 * node + 1 + (row[feature[node]] >= split[node])
        total += path[node]
    return 2 ** -(total / len(forest["path"]) / forest["norm"][0])


def average_path(n):
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def test_verdicts_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    forest, edge = quality.fit(quality.document_counts(spark.read.parquet(f"{d}/documents.parquet")), spark.read.parquet(f"{d}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality.op7_quality_rules(spark, d).collect()}
    scores = {}
    for i, t in rows:
        scores[i] = plain_score(forest, plain_features(t))
        assert abs(got[i]["anomaly"] - scores[i]) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and scores[i] < edge)
    # the threshold, from rows that the forest has not seen
    other = {r[0] for r in spark.createDataFrame([(i,) for i, _ in rows], "id long").selectExpr("id", "xxhash64(id, 17) % 2 as h").where("h <> 0").collect()}
    told = [(i, q) for i, q in duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall() if i in other and not got[i]["base_failed"]]
    good, bad = ([scores[i] for i, q in told if q == k] for k in (1, 0))
    assert len(good) > 100 and sum(x >= edge for x in good) <= quality.LOST * len(good) and sum(x >= edge for x in bad) >= 0.9 * len(bad)


def test_path_lengths_against_brute_force():
    rows = np.random.default_rng(2).normal(size=(40, 6))
    forest = quality.grow(rows, rows.min(0), rows.max(0), trees=5, tree_rows=100)
    for feature, split, path in zip(forest["feature"], forest["split"], forest["path"]):

        def walk(node, part, level):
            if 2 * node + 2 >= len(split) or not np.isfinite(split[node]):
                assert abs(path[node] - (level + average_path(len(part)))) < 1e-9
                return
            right = part[:, feature[node]] >= split[node]
            walk(2 * node + 1, part[~right], level + 1)
            walk(2 * node + 2, part[right], level + 1)

        walk(0, rows, 0)


def test_threshold():
    good, bad = np.zeros(10, int), np.zeros(10, int)
    good[[2, 3, 7]], bad[[5, 8]] = [600, 398, 2], [4, 6]
    assert quality.threshold(good, bad, 0.002) == (4 + 1 / 2) / 10
    assert quality.threshold(good, bad, 0.001) == 8 / 10
    assert quality.threshold(good, 0 * bad) == np.inf == quality.threshold(0 * good, bad)


def test_finds_bad_and_keeps_good(spark):
    d = "/root/testdata/sf0.01"
    quality_of = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    rows = [r for r in quality.op7_quality_rules(spark, d).collect() if r["doc_id"] in quality_of and not r["base_failed"]]
    good = [r["kept"] for r in rows if quality_of[r["doc_id"]]]
    bad = [r["kept"] for r in rows if not quality_of[r["doc_id"]]]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_odd_rows(spark):
    texts = [None, "", " \n\n ", "a", "a b c a b c\n\nx\nx\n x\nx\r", "é|é #", "same line\nsame line\n\n\n", "w " * 100, "| " * 3 + "a\x0b\x0cb"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(None, "a b", "z"), (3, "a", "z")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (99, None)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r[0] is not None:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(texts[r[0]])
    assert quality.quality_rules(docs.limit(0), labels.limit(0)).collect() == []
    odd = docs.selectExpr("*", "1 as `a.b`", "2 as id", "3 as good", "'" + "y" * 10 + "' as n_words")
    more = odd.union(spark.createDataFrame([(90, "own words " * 400_000, "z", 1, 2, 3, "y"), (91, " ".join(f"w{k}" for k in range(90)), "z", 1, 2, 3, "y")], odd.schema))
    got = quality.keep_quality(more, labels)
    assert got.columns == odd.columns and [r[0] for r in got.collect()] == [91]
    short = quality.keep_quality(more, labels, keep_short=True).collect()
    assert sorted(str(r[0]) for r in short) == sorted(["3", "3", "4", "5", "6", "8", "91", "None"])
