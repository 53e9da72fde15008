import math
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from loomspan.llm import language_id as li


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    got = li.op10_language_id(spark, d).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(out) > 150 and sum(out) / len(out) >= 0.97


def bucket(gram):
    mask = 2**64 - 1
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & mask
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & mask
    return (h ^ h >> 31) & (li.BUCKETS - 1)


def plain_grams(t):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t)
    low = "".join(c for k, c in enumerate(low) if c != " " or k == 0 or low[k - 1] != " ")
    return [bucket(low[k : k + n]) for n in (1, 2, 3) for k in range(len(low) - n + 1) if low[k : k + n].strip()]


def brute(rows):
    """Naive Bayes with dictionaries: predicted language of each row."""
    seen, docs = {}, Counter()
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            seen.setdefault(lang, Counter()).update(plain_grams(t))
            docs[lang] += 1
    names = sorted(docs)
    size = {n: sum(seen[n].values()) + 0.5 * li.BUCKETS for n in names}
    logs = {n: {b: math.log((k + 0.5) / size[n]) for b, k in seen[n].items()} for n in names}
    out = []
    for _, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t) or not names:
            out.append(("und", 0.0))
            continue
        g = Counter(plain_grams(t))
        total = [sum(k * logs[n].get(b, math.log(0.5 / size[n])) for b, k in g.items()) for n in names]
        prior = [math.log((docs[n] + 1) / (sum(docs.values()) + len(names))) for n in names]
        best = max(range(len(names)), key=lambda j: total[j] + prior[j])
        mean = [20 * x / sum(g.values()) + q for x, q in zip(total, prior)]
        out.append((names[best], math.exp(mean[best] - max(mean)) / sum(math.exp(m - max(mean)) for m in mean)))
    return out


def test_against_brute_force(spark, sf, monkeypatch):
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()
    rows += [(10_000 + k, t, f"l{k % 7}") for k, (_, t, _) in enumerate(rows[:60])]
    want = {i: w for (i, _, _), w in zip(rows, brute(rows))}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, id int").withColumn("a.b", F.lit(1))
    for most in (li.LANGUAGES, 3):  # one block of languages, and several
        monkeypatch.setattr(li, "LANGUAGES", most)
        got = {r["doc_id"]: r for r in li.language_id(df).collect()}
        assert {i: r["lang_pred"] for i, r in got.items()} == {i: w[0] for i, w in want.items()}
        assert all(abs(got[i]["score"] - w[1]) < 1e-3 for i, w in want.items())


def test_odd_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !? \n", "de"), (None, "the dog", "en"), (0, "the cat", "en"), (103, "日本", None), (104, "a" * 500_000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = li.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert [by[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and by[100]["score"] == 0
    assert by[0]["lang_pred"] == "en" and by[1]["lang_pred"] == "de" and by[103]["lang_pred"] in ("en", "de")
    assert {r["lang_pred"] for r in li.language_id(df.withColumn("lang", df.lang.substr(1, 0)).where("false")).collect()} == set()
    assert {r["lang_pred"] for r in li.language_id(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
