import hashlib
import random
import re
import time

import duckdb

from loomspan.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    least, out = {}, []
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), rest(rows[len(out)][1] or "", gone)))
    return out


def rest(t, gone):
    """The text without the words at the given places: kept white space, and a line feed or a space where words went."""
    if not gone:
        return t
    out, last = "", None
    for k, m in enumerate(WORD.finditer(t)):
        if k in gone:
            continue
        if last:
            gap = t[last[1] : m.start()]
            out += gap if last[0] == k - 1 else "\n" if "\n" in gap else " "
        out += m[0]
        last = (k, m.end())
    return out


def key(rows):
    return sorted(map(str, rows))


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t, _ in brute(rows)}
    assert {tuple(r) for r in sd.op6_substring_dedup(spark, sf).collect()} == want


def test_small_slices(spark, monkeypatch):
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(400)}" for _ in range(rng.randrange(5, 40))] for _ in range(25)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [f"q{rng.randrange(3000)}é" for _ in range(rng.randrange(12))]
        rows.append((i * 37 % 1000 - 300, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(2000 + k, rows[5][1]) for k in range(40)] + [(None, rows[7][1]), (3000, None), (3001, ""), (3002, " \n"), (3003, "a " * 5000), (2, "b " * 13)]
    monkeypatch.setattr(sd, "SLICE_BYTES", 2000)
    monkeypatch.setattr(sd, "RANGE_KEYS", 300)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, slice string")
    for size in (13, 4):
        assert key(tuple(r)[:4] for r in sd.substring_dedup(df, size=size).collect()) == key((*b[:3], b[4]) for b in brute(rows, size))
    kept = {(i, t): b[4] if b[2] else t for (i, t), b in zip(rows, brute(rows))}
    clash = df.selectExpr("*", "1 as id", "2 as crc", "3 as kept_text", "4 as `a.b`", "5 as `row`", "6 as loomspan_id", "7 as loomspan_text")
    got = sd.drop_repeats(clash)
    assert got.columns == clash.columns
    assert key((r[0], r[1], *r[2:]) for r in got.collect()) == key((i, kept[i, t], "x", 1, 2, 3, 4, 5, 6, 7) for i, t in rows)


def test_empty_table(spark):
    assert sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffles_go_with_their_step(spark, sf):
    """What a step shuffled is gone after it, without garbage collection by the driver; the setting is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        files = disk.getAllFiles()
        names = [files.apply(k).getName() for k in range(files.size())]
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before, was = shuffled(), spark.conf.get(setting)
    sd.drop_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    end = time.time() + 20  # Spark doesn't wait for the deletion
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(setting) == was
