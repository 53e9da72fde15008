import duckdb
import numpy as np

from loomspan.llm import buckets
from loomspan.llm import embedding_dedup as ed


def brute(rows, least=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        v = v / np.abs(v).max()
        ok[k] = v / np.linalg.norm(v)
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    first = {}
    for k, (i, _, _) in enumerate(rows):  # rows that share an id are one node
        if i is not None:
            parent[root(k)] = root(first.setdefault(i, k))
    part = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            part[root(k)] = min(part.get(root(k), i), i)
    return [(i, links[k], part.get(root(k)) if i is not None else None, i is None or part[root(k)] == i) for k, (i, _, _) in enumerate(rows)]


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    assert key(ed.op4_embedding_dedup(spark, sf).collect()) == key(brute(rows))


def test_recall_at_a_larger_size(spark):
    """Links of every row against all pairs: the table's vectors, each with neighbours at a cosine from 0.975 to 0.995."""
    rng = np.random.default_rng(5)
    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    for i, v, label in rows[:]:
        u = np.array(v) / np.linalg.norm(v)
        w = rng.normal(size=len(u))
        w -= (w @ u) * u
        c = rng.uniform(0.975, 0.995)
        rows.append((100_000 + i, (c * u + (1 - c * c) ** 0.5 * w / np.linalg.norm(w)).tolist(), label))
    want = dict(brute_links(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in ed.embedding_dedup(df).collect()}
    asked = [i for i in want if i % 100 == 0]
    assert sum(want.values()) > 2000 and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values())
    assert sum(got[i] for i in asked) >= 0.99 * sum(want[i] for i in asked) > 0


def brute_links(rows):
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    return [(r[0], int(n) - 1) for r, n in zip(rows, linked.sum(1))]


def test_shared_ids_and_names(spark):
    e = np.eye(12)
    rows = [(1, e[0], 1), (1, e[1], 1), (2, 2 * e[0], 1), (3, e[1] + 0.01 * e[2], 1), (4, e[5], 1), (4, e[6], 2), (5, e[6], 2), (6, e[7], 1), (6, None, 1), (7, None, 1), (7, e[5] + 0.02 * e[3], 1)]
    rows += [(8, np.resize(e[0], 5000), 1), (9, np.resize(3 * e[0], 5000), 1)]
    rows = [(i, None if v is None else v.tolist(), k) for i, v, k in rows]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, vec int").withColumnRenamed("vec", "a.b").repartition(3)
    assert key(ed.embedding_dedup(df).collect()) == key(brute(rows))


def test_groups_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        base = rng.normal(size=40)
        for _ in range(40):
            rows.append((int(rng.integers(10**6)) * 1000 + len(rows), (base + rng.normal(size=40) * 0.11).tolist(), "ab"[k % 2]))
    rows += [(len(rows) * 7 + k, rows[3][1], "b") for k in range(30)] + [(9 * k + 10**10, rows[4][1], "a") for k in range(10)]
    monkeypatch.setattr(buckets, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got, want = (sorted(map(tuple, x)) for x in (ed.embedding_dedup(df).collect(), brute(rows)))
    assert sum(w[1] for w in want) > 300
    assert abs(sum(g[1] for g in got) - sum(w[1] for w in want)) <= 0.02 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, None), (4, v, 2), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1)]
    rows += [(10, [1.0, 2.0], 1), (11, [], 1), (None, v, 1), (12, [1e200, 2e200, 3e200], 1), (13, [-0.0, 1.0, 0.0], 3), (14, [0.0, 1.0, 0.0], 3), (15, v + [4.0], 1), (16, v + [4.0], 1), (17, [1e-200, 2e-200, 3e-200], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    assert key(ed.embedding_dedup(df).collect()) == key(brute(rows))
    assert ed.embedding_dedup(df.limit(0)).collect() == []


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    assert np.allclose((ed.hadamard(ed.hadamard(x.copy())) / 8), x)
