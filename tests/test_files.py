import socketserver
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import grid, kmeans
from loomspan.plans import params
from loomspan.sinks import files as sinks
from loomspan.sources import files
from loomspan.streaming import streams


def test_lines_points_and_ints(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a\n\n b \nlast\n")
    got = files.text_lines(spark, str(tmp_path / "lines.txt")).orderBy("line_no").collect()
    assert [r["value"] for r in got] == ["a", "", " b ", "last"]
    (tmp_path / "points.txt").write_text("1 2.5\n 3\t-4 \n\n")
    got = files.point_file(spark, str(tmp_path / "points.txt")).orderBy("point_id").collect()
    assert [r["coords"] for r in got] == [[1.0, 2.5], [3.0, -4.0]] and got[0]["weight"] == 1.0
    (tmp_path / "wrong.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="line 2 has 1 numbers"):
        files.point_file(spark, str(tmp_path / "wrong.txt")).collect()
    (tmp_path / "ints.txt").write_text("5 -3\n\t7 x 9")
    assert [tuple(r) for r in files.int_file(spark, str(tmp_path / "ints.txt")).orderBy("pos").collect()] == [(0, 5), (1, -3), (2, 7)]


def test_report_and_plot(spark, tmp_path):
    values = [0.0, 0.2, 3.0, 3.4, -0.2, 0.0]
    (tmp_path / "p.txt").write_text("\n".join(map(str, values)))
    points = kmeans.points(files.point_file(spark, str(tmp_path / "p.txt")), "point_id", "coords")
    found = kmeans.kmeans(points, 2, kmeans.round_robin(2))
    report = str(tmp_path / "r")
    sinks.cluster_report(kmeans.assign(points, found.centres), found, report, {"centroids": 2})
    blocks = files.report_blocks(spark, report).orderBy("point_id").collect()
    assert [r["cluster_id"] for r in blocks][2:4] == [blocks[2]["cluster_id"]] * 2 and len(blocks) == 6
    sinks.plot_files(spark, str(tmp_path / "p.txt"), report, str(tmp_path / "plot"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "plot")).collect()]
    assert lines[0] == f"0.0 {blocks[0]['cluster_id']}" and len(lines) == 6
    (tmp_path / "two.txt").write_text("id:1 d²=0.5\nx\nid:0 d²=1\nid:1 d²=2.0\n")
    assert sorted(tuple(r) for r in files.report_blocks(spark, str(tmp_path / "two.txt")).collect()) == [(0, 0, 1, 0.5), (1, 0, 0, 1.0), (1, 1, 1, 2.0)]
    joined = sinks.positional_join(points.where("point_id < 2"), files.report_blocks(spark, str(tmp_path / "two.txt")))
    assert sorted((r["trial"], r["point_id"], r["cluster_id"]) for r in joined.collect()) == [(1, 0, 0), (1, 1, 1)]



def test_a_trial_of_many_points_is_dealt_to_tasks(spark, tmp_path):
    n = 4000
    points = spark.range(n, numPartitions=3).select(F.concat_ws(" ", F.col("id"), F.lit("0.5")).alias("value"))
    points.write.text(str(tmp_path / "points"))  # three files, read as one in name order
    got = files.point_file(spark, str(tmp_path / "points")).collect()
    assert sorted((r["point_id"], r["coords"]) for r in got) == [(k, [float(k), 0.5]) for k in range(n)]
    spark.range(n).select(F.concat(F.lit("id:"), F.col("id") % 7, F.lit(" d²=0.0")).alias("value")).coalesce(1).write.text(str(tmp_path / "report"))
    with coalesced(spark, "false"):
        sinks.plot_files(spark, str(tmp_path / "points"), str(tmp_path / "report"), str(tmp_path / "plot"))
    parts = sorted((tmp_path / "plot" / "trial=0").glob("part-*"))
    assert len(parts) > 1
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"{float(k)} 0.5 {k % 7}" for k in range(n)]


def test_lines_keep_their_places_in_parts_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, lines in (("b", range(3000)), ("a", range(5000, 5100)), ("c", [])):
        (tmp_path / "in" / name).write_text("".join(f"{x}\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = files.text_lines(spark, str(tmp_path / "in"))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Sort") == 0
        rows = sorted((r["file"][-1], r["line_no"], int(r["value"])) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [("a", k, 5000 + k) for k in range(100)] + [("b", k, k) for k in range(3000)]


@contextmanager
def coalesced(spark, value):
    """With Spark's own joining of small partitions set."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_text_csv_and_image(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int")
    sinks.key_value_text(df, "k", "v", str(tmp_path / "kv"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "kv")).collect()} == {"a 2", "b 1"}
    sinks.key_value_text(df.where("false"), "k", "v", str(tmp_path / "none"))
    assert spark.read.schema("value string").text(str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([(2, 10, 1.5)], "threads int, size int, chrono double")
    for _ in range(2):
        sinks.report_csv(rows, str(tmp_path / "csv"), ["size", "chrono"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).collect()] == [("10", "1.5")] * 2
    with pytest.raises(ValueError):
        sinks.report_csv(rows, str(tmp_path / "csv"), ["nonsense"])
    image = grid.colours(grid.pixels(spark, 3, 2, 0, 0, 1, 1).withColumn("n", F.col("row") * 100 + F.col("col")))
    sinks.write_ppm(image, 3, 2, str(tmp_path / "i.ppm"))
    assert (tmp_path / "i.ppm").read_bytes() == b"P6\n3 2\n255\n" + bytes([0, 0, 0, 1, 0, 0, 2, 0, 0, 100, 0, 0, 101, 0, 0, 102, 0, 0])
    sinks.sorted_files(df, ["v"], str(tmp_path / "sorted"), ["k"])
    assert {r["k"] for r in spark.read.text(str(tmp_path / "sorted")).collect()} == {"a", "b"}
    sinks.sorted_files(df, ["v"], str(tmp_path / "one"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "one")).collect()] == ["b 1", "a 2"]


def test_sort_experiment(spark, tmp_path):
    (tmp_path / "v.txt").write_text(" ".join(str(x * 7 % 100) for x in range(100)))
    got = params.sort_experiment(spark, params.parse_options([f"input={tmp_path}/v.txt", "threads=[1..2]", "threshold=4"], params.SORT_OPTIONS)).collect()
    assert [(r["threads"], r["threshold"], r["size"]) for r in got] == [(1, 4, 100), (2, 4, 100)]
    more = [f"input={tmp_path}/v.txt", "threads=3", "ratio=1:3", f"result={tmp_path}/out", f"report.file={tmp_path}/report", f"log={tmp_path}/log", "log.dim=3", "chrono=0"]
    got = params.sort_experiment(spark, params.parse_options(more, params.SORT_OPTIONS)).collect()
    assert [r["parameters"] for r in got] == ["ratio=1:3"]
    assert [r["v"] for r in files.int_file(spark, str(tmp_path / "out")).orderBy("pos").collect()] == list(range(100))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "report"), sep=";", header=True).collect()] == [("3", "100", "0", "ratio=1:3")]
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == [f"input={tmp_path}/v.txt threads=3 threshold=0 size=100 0 1 2"]
    for wrong in ({"ratio": ["3"]}, {"ratio": ["0:1"]}, {"colour": [1]}):
        with pytest.raises(ValueError):
            params.sort_experiment(spark, {"input": [f"{tmp_path}/v.txt"]} | wrong)



def test_a_large_sort_has_more_ranges_than_threads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(params, "RANGE", 100, raising=False)
    (tmp_path / "v.txt").write_text("\n".join(f"{x * 7 % 1000} {x}" for x in range(500)))
    params.sort_experiment(spark, params.parse_options([f"input={tmp_path}/v.txt", "threads=1", f"result={tmp_path}/out"], params.SORT_OPTIONS))
    parts = [[int(x) for x in p.read_text().split()] for p in sorted((tmp_path / "out").glob("part-*"))]
    assert len(parts) == 10 and max(map(len, parts)) < 200
    assert [x for p in parts for x in p] == sorted([x * 7 % 1000 for x in range(500)] + list(range(500)))


def test_streams(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 2).alias("key"), F.col("id").alias("ord"), F.col("id").cast("double").alias("x"))
    for part in range(4):
        df.where(f"ord div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    got = streams.run_to_table(streams.count_windows(stream, 3, "key", ["ord"], "x", lambda a, b: a + b), "w").collect()
    assert {(r["key"], r["ord"], r["result"]) for r in got} == {(i % 2, i, float(3 * i - 6)) for i in range(4, 40)}
    ones = streams.run_to_table(streams.count_windows(stream, 1, "key", ["ord"], "x", lambda a, b: a + b), "w1")
    assert ones.where("result <> ord").count() == 0 and ones.count() == 40
    query = streams.drained(stream, lambda row: None)
    query.processAllAvailable()
    query.stop()


def test_fast_and_slow_folds_agree(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 3).alias("key"), F.col("id").alias("ord"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    for part in range(3):
        df.where(f"ord div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    for name, op in (("sum", lambda a, b: a + b), ("min", min), ("max", max)):
        for k in (1, 4):
            fast, slow = (sorted(map(tuple, streams.run_to_table(streams.count_windows(stream, k, "key", ["ord"], "x", o), "w").collect())) for o in (name, op))
            assert fast == slow and len(fast) == 60 - 3 * (k - 1)
    with pytest.raises(ValueError):
        streams.count_windows(stream, 2, "key", ["ord"], "x", "median")


def test_socket_source_and_console(spark, tmp_path, capfd):
    with socketserver.TCPServer(("127.0.0.1", 0), Numbers) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        stream = files.element_stream(spark, host="127.0.0.1", port=server.server_address[1])
        query = stream.selectExpr("cast(value as int) as v").writeStream.format("memory").queryName("popped").start()
        try:
            deadline = time.time() + 60
            while spark.table("popped").count() < 5 and time.time() < deadline:
                time.sleep(0.5)
        finally:
            query.stop()
            server.shutdown()
    assert sorted(r["v"] for r in spark.table("popped").collect()) == [0, 1, 4, 9, 16]
    assert files.element_stream(spark, source="rate", rowsPerSecond=5).columns == ["timestamp", "value"]
    spark.range(3).selectExpr("id + 7000 as v").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = streams.to_console(streams.file_stream(spark, str(tmp_path / "in")))
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None and query.lastProgress["sink"]["numOutputRows"] == 3


class Numbers(socketserver.BaseRequestHandler):
    """Five squares, a line each; then the connection stays open, as a closed one ends the source."""

    def handle(self):
        self.request.sendall(b"".join(b"%d\n" % (i * i) for i in range(5)))
        self.request.recv(1)


def test_scratch(spark):
    t = scratch.written(spark.range(3), "t")
    assert t.count() == 3
    with scratch.passing() as keep:
        other = scratch.written(spark.range(2), "other")
        keep.append(scratch.written(other.selectExpr("id + 1 as id"), "kept"))
    assert keep[0].count() == 2 and t.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(other._loomspan_path)
    scratch.drop(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._loomspan_path)
