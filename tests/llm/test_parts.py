import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import _words as w
from loomspan.llm import minhash_dedup, packing, quality, substring_dedup
from loomspan.llm._batches import bounded_batches, lean
from loomspan.llm._runs import runs
from loomspan.llm.components import connected_components
from loomspan.scratch import written


def test_components_of_chains_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(350)] + [(5, 5), (7, 6), (7, 6), (None, 3), (3, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, root(i)) for i in list(parent)} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_batch_size_is_set_back(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    with pytest.raises(ZeroDivisionError):
        with bounded_batches(spark):
            assert int(spark.conf.get(setting)) == 2000
            1 / 0
    assert spark.conf.get(setting) == before


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    df = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) as text")
    with bounded_batches(spark):
        got = [r[0] for r in df.mapInArrow(lean(sizes), "n long").collect()]
    assert sum(got) >= 60_000_000 and max(got) < 12_000_000


def test_jobs_on_texts_have_bounded_batches(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for module in (packing, quality, minhash_dedup, substring_dedup):
        monkeypatch.setattr(module, "written", lambda df, name: (seen.__setitem__(name, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), written(df, name))[1])
    packing.pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    quality.document_counts(docs)
    minhash_dedup.minhash_dedup(docs)
    substring_dedup.drop_repeats(docs)
    assert {"pieces", "counts", "signed", "full", "anchors", "repeats", "kept"} <= set(seen) and max(seen.values()) <= 2000


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n語", max_size=12), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = w.texts(pa.array(texts, pa.string()))
    starts, ends, at = w.bounds(data, offsets)
    h = w.hashes(data, starts, ends)
    seen = {}
    for k, t in enumerate(texts):
        words = t.encode().split()
        assert [bytes(data[a:b]) for a, b in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]])] == words
        for word, x in zip(words, h[at[k] : at[k + 1]].tolist()):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_cut(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    data, offsets = w.texts(pa.array([None, text, ""]))
    starts, ends, _ = w.bounds(data, offsets)
    whole = w.hashes(data, starts, ends)
    monkeypatch.setattr(w, "SLICE", 50)
    assert (w.hashes(data, starts, ends) == whole).all()
    assert len(np.unique(w.windows(whole, 3))) == 97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.integers(1, 7))
def test_runs_are_whole(keys, size):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size], pa.int64())], ["k"]) for k in range(0, len(keys), size)]
    got = [r.column("k").to_pylist() for r in runs(iter(batches), ["k"])]
    assert [x for r in got for x in r] == keys and all(len(set(r)) == 1 for r in got) and len(got) == len(set(keys))
