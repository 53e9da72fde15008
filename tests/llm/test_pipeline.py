import duckdb
import pandas as pd

import corpus_pipeline as cp
from loomspan.llm import quality
from loomspan.llm.line_dedup import template_sql
from loomspan.scratch import written
from tests.llm.test_minhash_dedup import brute as near
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import brute as repeats


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, rows_of(docs)
    kept = {r["doc_id"] for r in quality.op7_quality_rules(spark, sf).collect() if r["kept"] or 0 < r["n_words"] < 50}
    want = [(i, t) for i, t in rows if i in kept]
    for (name, stage), expect in zip(cp.STAGES[:4], (lambda _: want, by_sql, by_groups, by_windows)):
        before = rows
        docs = written(stage(spark, docs, sf), name)
        rows = rows_of(docs)
        assert docs.columns == columns and rows == sorted(expect(before))
    assert 0 < len(rows) < 200
    check(rows, cp.packing(spark, docs, sf).collect())


def by_sql(rows):
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    return duckdb.sql(f"""WITH {template_sql("docs")} SELECT d.doc_id, CASE WHEN g.places IS NULL THEN d.text ELSE
        coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.places, i - 1)), chr(10)), '') END
        FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text""").fetchall()


def by_groups(rows):
    stay = {r[0] for r in near(rows, 5, 80) if r[3]}
    return [(i, t) for i, t in rows if i in stay]


def by_windows(rows):
    return [(i, b[4] if b[2] else t) for (i, t), b in zip(rows, repeats(rows))]


def test_odd_rows_through_every_stage(spark, sf):
    """Nulls in any column, empty texts, repeated rows, shared ids, columns whose names clash, and the empty table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    text = docs.where("length(text) > 400").first()["text"]
    rows = [(None, text, "en", "s", 1), (None, None, None, None, None), (9001, "", "en", None, 0), (9002, text, None, "s", None), (9002, text, None, "s", None), (9003, text + " x", "en", "s", 3), (9002, "other words of one id", "en", "s", 3), (9004, " \n ", "en", "s", 3)]
    names = ["a.b", "id", "row", "text_hash", "gone", "crc", "kept_text", "component_id", "kept", "n", "loomspan_gone", "loomspan_id", "loomspan_text", "piece", "length"]
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).selectExpr("*", *(f"{k} as `{c}`" for k, c in enumerate(names)))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            before, now = now.count(), written(stage(spark, now, sf), name)
            assert name == "best_fit_packing" or now.columns == docs.columns
            assert name in ("quality_rules", "minhash_dedup", "best_fit_packing") or now.count() == before
        assert now.where("sequence_id is null").count() == 0 and (now.count() == 0) == empty
    got = written(cp.near_copies(spark, docs, sf), "near").collect()
    assert [r["doc_id"] for r in got if r["doc_id"] in (9002, 9003)] in ([], [9002] * 3) and sum(r["doc_id"] is None for r in got) == 2


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
