import datetime

from loomspan.llm import line_dedup, url_filter
from loomspan.llm.line_dedup import OP9_SQL, op9_line_dedup
from loomspan.llm.url_filter import OP5_SQL, op5_url_filter
from tests.oracle import same

D = "/root/testdata/sf0.01"


def test_against_sql(spark):
    assert same(op5_url_filter(spark, D), OP5_SQL, D) == 250
    assert same(op9_line_dedup(spark, D), OP9_SQL, D) == 1000


def test_only_dataframe_functions(spark):
    for df in (op5_url_filter(spark, D), op9_line_dedup(spark, D)):
        assert "Python" not in df._jdf.queryExecution().toString()


def test_texts_meet_lost_lines_by_one_plan_at_any_size(spark):
    plan = op9_line_dedup(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lines(spark):
    line = "Posted by user {} on 2024-01-0{} in the news section of it"
    rows = [(k, f"own text {'x' * k}\n" + line.format(["ann", "bob", "eve", "joe", "sue", "kim"][k], k) + "\n\nAll rights reserved.\t") for k in range(6)]
    rows += [(50, rows[0][1]), (7, None), (8, ""), (9, "\n\n"), (None, "All rights reserved."), (10, "All rights  reserved.\nAll rights reserved.\nnew"), (0, "All rights reserved. "), (11, "z " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id long, gone int").selectExpr("*", "3 as `a.b`", "4 as loomspan_gone", "5 as loomspan_id", "6 as `row`")
    got = sorted(map(str, ((r[0], r[1]) for r in line_dedup.drop_templates(df).collect())))
    kept = {}
    for i, t in rows:
        if i in (None, 7, 8, 9, 11) or t == rows[0][1]:
            kept[i, t] = t
        elif i == 10:
            kept[i, t] = "new"
        elif i == 0:
            kept[i, t] = ""
        else:
            kept[i, t] = f"own text {'x' * i}\n"
    # the text of id 0 that sorts first by id and hash is the one that keeps its lines
    first = [r for r in line_dedup.drop_templates(df).collect() if r[0] == 0]
    assert len(got) == len(rows) and line_dedup.drop_templates(df).columns == df.columns
    assert len(first) == 2
    assert all(str((i, k)) in got for (i, t), k in kept.items() if i not in (0, 50))
    assert line_dedup.line_digests(df.limit(0)).collect() == []


def test_rows_of_numbers_stay(spark):
    data = ["{k}.5 1{k} 7", "1{k} | 2{k} | 3{k}", "{k} 2 3 4 5 6 7 8 9", "x{k} 1 2 3", "2024 {k} on 1 2 3 4 5 6 7"]
    rows = [(k, "\n".join([*(x.format(k=k) for x in data), "0 0 0", f"Page {k} of {k + 9} in total"])) for k in range(6)]
    got = {r[0]: r[1].split("\n") for r in line_dedup.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: [*(x.format(k=k) for x in data), *(["0 0 0", "Page 0 of 9 in total"] if k == 0 else [])] for k in range(6)}


def test_fields_at_any_places(spark):
    who, where = ["ann", "bob", "eve", "joe", "sue", "kim"], ["sports", "news", "arts", "food", "cars", "books"]
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(48))
    forms = ["Posted by {a} in {b}", "Written for you with {a} and a lot of help by {b} too", long + " {a} and then {b}"]
    rows = [(7 * i + j, "\n".join([f"{a} {b} own {a}{b}", *(x.format(a=a, b=b) for x in forms)])) for i, a in enumerate(who) for j, b in enumerate(where)]
    docs = spark.createDataFrame(rows + [(90, rows[-1][1])], "doc_id long, text string")
    got = {r[0]: r[1].split("\n") for r in line_dedup.drop_templates(docs).collect()}
    assert got == {i: t.split("\n")[: None if i == 0 else 1] for i, t in rows} | {90: rows[-1][1].split("\n")[:1]}
    few = docs.where("doc_id in (0, 8, 16, 24)")
    assert sorted(map(tuple, line_dedup.drop_templates(few).collect())) == sorted(map(tuple, few.collect()))


def test_urls(spark):
    day = datetime.date
    entries = [("domain", "A.b", "block", day(2024, 1, 5)), ("domain", "a.b", "lift", day(2024, 1, 9)), ("host", "x.a.b", "allow", day(2024, 1, 7)), ("path", "x.a.b/p/q", "block", day(2024, 1, 1)), ("host", "h", "allow", day(2024, 1, 1)), ("host", "h", "block", day(2024, 1, 1)), ("host", "h", "block", day(2024, 1, 1)), (None, "a", "block", day(2024, 1, 1)), ("host", "a", "nonsense", day(2024, 1, 1))]
    rows = [
        (1, "http://y.A.B/", day(2024, 1, 4), False), (2, "http://y.a.b:80/", day(2024, 1, 5), True), (3, "http://u@y.a.b./?q", day(2024, 1, 9), False),
        (4, "https://x.a.b/p", day(2024, 1, 8), False), (5, "https://x.a.b/p//Q/r?z", day(2024, 1, 8), True), (6, "https://x.a.b/p/qq", day(2024, 1, 6), True),
        (7, "http://za.b/", day(2024, 1, 6), False), (8, None, day(2024, 1, 6), False), (9, "nonsense", day(2024, 1, 6), False), (10, "http://h", None, False),
        (11, "ftp://h#x", day(2024, 2, 1), True), (11, "ftp://h#x", day(2024, 2, 1), True), (None, "http://h/", day(2024, 2, 1), True),
    ]
    captures = spark.createDataFrame([(*r[:3], "k") for r in rows], "page_id long, url string, fetched_at date, kind string")
    listed = spark.createDataFrame(entries, "kind string, subject string, verdict string, since date")
    long = "http://" + "l." * 3000 + "a.b/" + "p/" * 3000
    more = captures.union(spark.createDataFrame([(12, long, day(2024, 1, 6), "k"), (13, "", day(2024, 1, 6), "k")], captures.schema)).selectExpr("*", "1 as `a.b`", "2 as id", "3 as subject")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            got = url_filter.url_filter(more, listed).collect()
            assert sorted(str((r["page_id"], r["blocked"])) for r in got) == sorted([*(str((r[0], r[3])) for r in rows), "(12, True)", "(13, False)"])
            assert same(op5_url_filter(spark, D), OP5_SQL, D) == 250
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert url_filter.url_filter(captures.limit(0), listed.limit(0)).collect() == []
