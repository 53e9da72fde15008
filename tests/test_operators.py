import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan import queries
from loomspan.functions import text, vectors
from loomspan.operators import divide, grid, kmeans, mapreduce, positions, sorting, windows
from loomspan.plans import params
from loomspan.sources import generators


def column(df):
    return [r[0] for r in df.collect()]


# parameters


@pytest.mark.parametrize(
    "written, values",
    [
        ("[10,11..16..17,19..24]", [10, 11, 12, 13, 14, 15, 16, 17, 19, 21, 23]),
        ("[10..13,9..0]", [10, 11, 12, 13, 9, 5, 1]),
        ("7", [7]),
        ("-3", [-3]),
        ("[5,5..8]", [5, 5, 6, 7, 8]),
        ("[3..1]", [3, 2, 1]),
        ("[1,3..2]", [1, 3]),
        ("[1,2..0]", [1, 2, 1, 0]),
        ("[4]", [4]),
    ],
)
def test_ranges(written, values):
    assert params.parse_values(written) == values


def test_float_range_never_passes_its_end():
    assert params.parse_values("[1..2.5]", "float") == [1.0, 2.0]
    assert params.parse_values("[.5,1..2]", "float") == [0.5, 1.0, 1.5, 2.0]


def test_options():
    kinds = {"n": "int", "name": "string", "x": "double"}
    assert params.parse_options(["n=1", "name=[a,b c]", "n=[3..4]", "x=.5"], kinds) == {"n": [1, 3, 4], "name": ["a", "b c"], "x": [0.5]}
    assert params.parse_options(["n:2"], kinds, ":") == {"n": [2]} and params.parse_options(["n2"], {"n": "int"}, "") == {"n": [2]}
    for wrong in ("y=1", "n=a", "n=[1,", "n=[1..]", "n=[1;2]"):
        with pytest.raises(ValueError):
            params.parse_options([wrong], kinds)


def test_sweep_stops_at_false():
    seen = []
    rows = params.sweep({"a": [1, 2], "b": [3, 4]}, lambda a, b: seen.append((a, b)) or (a, b) != (1, 4))
    assert seen == [(1, 3), (1, 4)] and len(rows) == 2 and rows[0]["chrono"] >= 0


def test_grid_order(spark):
    rows = params.grid(spark, {"a": [1, 2], "b": ["x", "y"], "c": [0.5]}).orderBy("config").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "x", 0.5), (1, 1, "y", 0.5), (2, 2, "x", 0.5), (3, 2, "y", 0.5)]


# scalar functions


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 4.0], [3.0, 1.0], 2.0)], "p array<double>, q array<double>, w double")
    got = df.select(
        vectors.distance(F.col("p"), F.col("q")).alias("a"),
        vectors.distance(F.col("p"), F.col("q"), 3).alias("b"),
        vectors.weighted_distance(F.col("p"), F.col("w"), F.col("q"), F.lit(1.0)).alias("c"),
        vectors.added(F.col("p"), F.col("q")).alias("d"),
        vectors.subtracted(F.col("p"), F.col("q")).alias("e"),
        vectors.zeros(2).alias("f"),
        vectors.listed(F.col("p").cast("array<int>")).alias("g"),
    ).first()
    assert tuple(got) == (13.0, 19.0, 7.25, [4.0, 5.0], [-2.0, 3.0], [0.0, 0.0], "[1,4]")
    numbers = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 7, 8, 1000)], "n long")
    assert column(numbers.select(vectors.all_ones(F.col("n")))) == [0, 1, 3, 3, 7, 7, 15, 1023]
    assert column(numbers.select(vectors.power(F.col("n"), 3)))[-1] == 10**9 and vectors.power(F.lit(3), 0) is not None
    assert all(0 <= b < 5 for b in column(numbers.select(vectors.bucket_of(F.col("n"), 5))))
    assert column(spark.range(1).select(text.starts_with_name(F.lit("n=3"), "n"))) == [True]


def test_tokens(spark):
    df = spark.createDataFrame([("a  b a",), ("x\ty\n\n z",), (None,), ("",)], "text string")
    assert {tuple(r) for r in mapreduce.word_count(df).collect()} == {("a", 2), ("b", 1), ("x\ty", 1), ("z", 1)}
    assert {tuple(r) for r in mapreduce.word_count(df, white_space=True).collect()} == {("a", 2), ("b", 1), ("x", 1), ("y", 1), ("z", 1)}


def test_python_map_reduce_keeps_line_order(spark):
    df = spark.createDataFrame([(f"k{i % 3} {i}",) for i in range(200)], "value string").coalesce(1)
    pair = lambda line: [tuple(line.split(" "))]
    for most in (2, 1000):
        got = dict(map(tuple, mapreduce.map_reduce_python(df, pair, lambda a, b: a + b, "key string, value string", most=most).collect()))
        assert got == {f"k{k}": "".join(str(i) for i in range(k, 200, 3)) for k in range(3)}
    assert mapreduce.map_reduce_python(df.limit(0), pair, lambda a, b: a + b, "key string, value string").collect() == []


def test_ordered_reduce_by_runs(spark):
    df = spark.range(900).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("string").alias("w"))
    whole, runs = (dict(map(tuple, mapreduce.reduce_by_key_ordered(df, "k", "w", ["id"], lambda a, b: F.concat(a, b), chunk=c).collect())) for c in (None, 50))
    assert whole == runs == {k: "".join(map(str, range(k, 900, 2))) for k in (0, 1)}


# windows, order


def test_windows(spark):
    df = generators.squares(spark)
    got = windows.window_reduce(df, 10, ["id"], {"s": lambda: F.sum("v")}).orderBy("id").collect()
    assert len(got) == 991 and got[0]["s"] == 285 and got[-1]["s"] == sum(i * i for i in range(990, 1000))
    same = windows.window_reduce(df, 1, ["id"], {"s": lambda: F.sum("v")})
    assert same.where("s <> v").count() == 0 and same.count() == 1000
    assert windows.window_reduce(df.limit(9), 10, ["id"], {"s": lambda: F.sum("v")}).count() == 0
    with pytest.raises(ValueError):
        windows.window_reduce(df, 0, ["id"], {})
    words = df.where("id < 30").select("id", F.col("id").cast("string").alias("w"))
    by_sql = windows.window_fold(words, 3, ["id"], "w", "concat(a, b)", "''", "f").orderBy("id").collect()
    by_python = windows.window_fold_python(words, 3, ["id"], "w", lambda a, b: a + b, "string", "f").orderBy("id").collect()
    assert [r["f"] for r in by_sql] == [r["f"] for r in by_python] == [f"{i}{i + 1}{i + 2}" for i in range(28)]


def test_latest_window(spark):
    df = generators.squares(spark)
    got = windows.latest(df, 10, ["id"], {"s": lambda: F.sum("v")}).collect()
    assert [(r["id"], r["s"]) for r in got] == [(999, sum(i * i for i in range(990, 1000)))]
    assert windows.latest(df.limit(9), 10, ["id"], {"s": lambda: F.sum("v")}).count() == 0


def test_operator_from_a_file(spark, tmp_path):
    (tmp_path / "plus.sql").write_text("-- sum of the window\na +\n b\n")
    op = windows.read_operator(spark, str(tmp_path / "plus.sql"))
    got = windows.window_fold(generators.squares(spark), 10, ["id"], "v", op, "cast(0 as bigint)", "s").orderBy("id").first()
    assert got["s"] == 285


@pytest.mark.parametrize("chunk", [7, 64])
def test_neighbours_over_chunk_borders(spark, chunk):
    df = spark.range(500).withColumnRenamed("id", "pos")
    columns = {"xs": lambda w: F.collect_list("pos").over(w.rowsBetween(-3, 2))}
    for r in positions.over_neighbours(df, "pos", 3, 2, columns, chunk).collect():
        assert r["xs"] == list(range(max(0, r["pos"] - 3), min(500, r["pos"] + 3)))


def test_positions_and_order(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    rows = sorting.sort_with_place(df, ["v", "k"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(5000)) and [(r["v"], r["k"]) for r in rows] == sorted((r["v"], r["k"]) for r in rows)
    assert column(sorting.is_sorted(df, "k", ["k"])) == [True] and column(sorting.is_sorted(df, "v", ["k"])) == [False]
    assert column(sorting.is_sorted(df.where("false"), "v", ["k"])) == [True]
    runs = sorting.merge_runs(df.where("k < 100").select("k", "v"), df.where("k between 100 and 150").select("k", "v"), "v", "k").orderBy("pos").collect()
    assert [(r["v"], r["run"], r["k"]) for r in runs] == sorted((r["v"], r["run"], r["k"]) for r in runs)
    assert [r["pos"] for r in sorting.order_violations(df.where("k < 200"), "k", ["k"]).collect()] == []
    found = {r["pos"]: (r["previous"], r["value"], r["around"]) for r in sorting.order_violations(df, "v", ["k"], 3).collect()}
    v = [r["v"] for r in df.orderBy("k").collect()]
    assert found == {i: (v[i - 1], v[i], v[max(0, i - 3) : i + 3]) for i in range(1, 5000) if v[i] < v[i - 1]}
    ranges = {r["v"]: (r["first_pos"], r["last_pos"]) for r in sorting.equal_ranges(df, "v").collect()}
    assert ranges == {x: (sorted(v).index(x), sorted(v).index(x) + v.count(x) - 1) for x in set(v)}
    for x in (-1, 0, 7, 49, 90):
        below, to = sum(y < x for y in v), sum(y <= x for y in v)
        assert tuple(sorting.equal_range(df, "v", x).first()) == (below if below < 5000 else None, to - 1 if to else None)
    total = positions.running_total(df, ["k"], "v", "t").orderBy("k").collect()
    assert [r["t"] for r in total] == np.cumsum(v).tolist()
    assert {r["part"] for r in sorting.partition3(df, "v", 7).collect()} == {-1, 0, 1}


# k-means



def test_violations_are_found_in_one_window(spark):
    rows = [(k, v) for k, v in enumerate([3, 1, None, 2, 5, 4, 4, None])]
    found = sorting.order_violations(spark.createDataFrame(rows, "k int, v int"), "v", ["k"], 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, 1, [3, 1, None]), (5, 5, 4, [2, 5, 4, 4])]
    # the only join is with the counts of the ranges: no row is made for each value around a violation
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    with pytest.raises(ValueError):
        sorting.order_violations(found, "value", ["pos"], 0)


def hand(spark):
    values = [0.0, 0.2, 3.0, 3.4, -0.2, 0.0]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)], "id long, v array<double>")
    return kmeans.points(df, "id", "v")


def test_kmeans_by_hand(spark):
    points = hand(spark)
    found = kmeans.kmeans(points, 2, kmeans.round_robin(2))
    got = {r["point_id"]: r["cluster_id"] for r in kmeans.assign(points, found.centres).collect()}
    assert found.converged and {i for i in got if got[i] == got[0]} == {0, 1, 4, 5}
    assert sorted(found.centres.ravel().round(6)) == [0.0, 3.2]
    assert all(a >= b - 1e-12 for a, b in zip(found.inertias, found.inertias[1:]))


def test_kmeans_repair(spark):
    points = hand(spark)
    found = kmeans.kmeans(points, 3, F.lit(0), max_iter=50)
    assert found.converged and (found.weights > 0).all() and found.weights.sum() == 6
    assert kmeans.kmeans(points, 7, kmeans.round_robin(7)) is None
    assert kmeans.kmeans(points.where("false"), 2, kmeans.round_robin(2)) is None


def test_kmeans_wrong_width(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="coordinates"):
        kmeans.kmeans(kmeans.points(df, "id", "v"), 1, kmeans.round_robin(1))


def test_weighted_points_equal_repeated_points(spark):
    single = [(i, [float(x)]) for i, x in enumerate([1, 1, 1, 9, 9, 2])]
    merged = [(0, [3.0], 3.0), (3, [18.0], 2.0), (5, [2.0], 1.0)]
    one = kmeans.kmeans(kmeans.points(spark.createDataFrame(single, "id long, v array<double>"), "id", "v"), 2, (F.col("point_id") == 3).cast("int"))
    df = spark.createDataFrame(merged, "id long, v array<double>, w double")
    two = kmeans.kmeans(kmeans.points(df, "id", "v", F.col("w")), 2, (F.col("point_id") == 3).cast("int"))
    assert np.allclose(one.centres, two.centres) and two.weights.sum() == 6


def test_assign_forms_agree(spark):
    blobs = generators.gaussian_blobs(spark, 300, 3, 4, 1)
    points = kmeans.points(blobs, "point_id", "coords")
    centres = [[0.0, 0.0, 0.0], [50.0, 0.0, -20.0], [0.0, 0.0, 0.0]]
    a = {r[0]: (r[1], round(r[2], 6)) for r in kmeans.assign(points, np.array(centres)).collect()}
    b = {r[0]: (r[1], round(r[2], 6)) for r in kmeans.assign_expr(points, centres).collect()}
    assert a == b and {v[0] for v in a.values()} <= {0, 1}


def test_scattered_takes_any_id(spark):
    ids = [0, 5, 9_000_000_000, 2**62, -(2**63)]
    df = spark.createDataFrame([(i,) for i in ids], "point_id long")
    got = column(df.select(kmeans.scattered(7, 3)))
    assert got == [((i * 1103515245 + 12345 * 4 & (1 << 31) - 1) >> 8) % 7 for i in ids]


def test_trials(spark):
    one, made = (kmeans.trials(hand(spark), 2, 3, parallel=p) for p in (1, 3))
    assert [c.centres.tolist() for _, c in one] == [c.centres.tolist() for _, c in made]
    assert [t for t, _ in made] == [0, 1, 2] and all(c.converged for _, c in made)


def lloyd(x, a, k):
    """Assignments by brute force until none changes, and the rounds."""
    for turn in range(1, 100_000):
        centres = np.array([x[a == c].mean(0) for c in range(k)])
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == a).all():
            return a, turn
        a = new


def test_kmeans_has_no_cap(spark):
    k, x = 10, np.arange(400, dtype=float)[:, None]
    want, turns = lloyd(x, np.minimum(np.arange(400) // 2, k - 1), k)
    start = F.least((F.col("point_id") / 2).cast("int"), F.lit(k - 1))
    points = kmeans.points(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1), "id", "v")
    found = kmeans.kmeans(points, k, start)
    assert turns > 101 and found.converged and found.rounds == turns
    assert [r["cluster_id"] for r in kmeans.assign(points, found.centres).orderBy("point_id").collect()] == want.tolist()
    capped = kmeans.kmeans(points, k, start, max_iter=2)
    assert not capped.converged and capped.rounds == 2


def test_kmeans_in_a_circle(spark):
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 0.0, 0.0, 5.0])], "id long, v array<double>")
    found = kmeans.kmeans(kmeans.points(df, "id", "v"), 3, kmeans.round_robin(3))
    assert not found.converged and found.rounds < 10


def test_trials_until_nothing_changes(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {(r["trial"], r["point_id"]): r["cluster_id"] for r in queries.kmeans_trials_converged(spark, sf).collect()}
    want = {}
    for t in range(2):
        a, turns = lloyd(x, ((ids * 1103515245 + 12345 * (t + 1) & (1 << 31) - 1) >> 8) % queries.K, queries.K)
        assert turns > 4
        want |= {(t, i): c for i, c in zip(ids.tolist(), a.tolist())}
    assert got == want


# grids


def test_escape_and_colours(spark):
    assert grid.escape_counts(np.array([0.0, 100.0]), np.array([0.0, 0.0]), 1600, 1600.0).tolist() == [1600, 1]
    counts = spark.createDataFrame([(0, 0, n) for n in (0, 255, 256, 511, 512, 767, 768, 1023, 1024, 1279, 1280, 1600)], "row int, col int, n int")
    got = [tuple(r)[3:] for r in grid.colours(counts).orderBy("n").collect()]
    assert got == [(0, 0, 0), (255, 0, 0), (0, 0, 0), (0, 255, 0), (0, 0, 0), (0, 0, 255), (0, 0, 255), (255, 0, 255), (255, 0, 255), (255, 255, 255), (255, 255, 255), (255, 255, 255)]
    assert column(grid.flipped(counts.limit(1), 4).select("row")) == [3]


def test_fractal_sweep(spark):
    base = {"pixelX": [20], "pixelY": [12], "grain": [5], "X": [-2.0], "Y": [-1.0], "sizeX": [2.5], "sizeY": [2.0]}
    got = params.fractal_sweep(spark, base | {"threshold": [10, 30], "threads": [2]})
    counts = [grid.tile_stats(grid.mandelbrot(grid.pixels(spark, 20, 12, -2.0, -1.0, 2.5, 2.0), t), 5, 20, 2) for t in (10, 30)]
    for config, want in enumerate(counts):
        rows = got.where(f"config = {config}").select("owner", "tiles", "total", "most").collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        params.fractal_sweep(spark, base | {"colour": [1]})


# divide and conquer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=40), st.floats(0.05, 0.95))
def test_divide_and_conquer_sorts(xs, ratio):
    assert divide.divide_and_conquer(xs, lambda p: len(p) < 2, list, divide.split_at(ratio), divide.merge_sorted) == sorted(xs)


def test_tree_fold_keeps_order(spark):
    df = spark.range(700).select("id", F.col("id").cast("string").alias("w"))
    assert column(divide.tree_fold(df, ["id"], "w", lambda a, b: a + b, fan=6)) == ["".join(map(str, range(700)))]
    assert column(divide.tree_fold(df.where("id < 1"), ["id"], "w", lambda a, b: a + b)) == ["0"]
    assert column(divide.tree_fold(df.where("false"), ["id"], "w", lambda a, b: a + b)) == []


# generators


def test_generators(spark):
    made = generators.batches(spark, 5, 10, seed=3)
    assert made.count() == 50 and made.where("value <= -1 or value >= 1").count() == 0
    assert column(made.select("value")) == column(generators.batches(spark, 5, 10, seed=3).select("value"))
    ints = generators.random_ints(spark, 1000, 1)
    assert ints.where("v < 0").count() > 300 and dict(ints.dtypes)["v"] == "int"
    assert generators.random_ints(spark, 100, 1, "double").where("v < 0").count() == 0
    assert generators.gaussian_blobs(spark, 10, 4, 2, 1).where("size(coords) = 4").count() == 10


def test_a_round_is_one_stage_and_one_assignment(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("point_id"), F.array(F.col("id") % 20 * 1.0, F.col("id") % 7 * 1.0).alias("coords"), F.lit(1.0).alias("weight"))
    found = kmeans.kmeans(df, 3, kmeans.round_robin(3))
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one round", "")
    kmeans._sums(df.withColumn("start", kmeans.round_robin(3)), 2, 3, found.centres, {}, 4)
    jobs = [stages.getJobInfo(j) for j in stages.getJobIdsForGroup("one round")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(j.stageIds) for j in jobs] == [1]
    monkeypatch.setattr(kmeans, "DRIVER_VALUES", 0)
    by_tasks = kmeans.kmeans(df, 3, kmeans.round_robin(3))
    assert found.converged and by_tasks.rounds == found.rounds and np.allclose(found.centres, by_tasks.centres, rtol=1e-12)
    near = found.centres * (1 + 1e-13)
    assert kmeans._same(df, found.centres, {}, found.centres) and kmeans._same(df, found.centres, {}, near) and not kmeans._same(df, found.centres, {0: 2, 1: 1, 2: 0}, near)
    assert not kmeans._same(df, found.centres, {}, found.centres + 1)


def test_groups_of_a_task_share_its_batches(spark):
    rows = [(k % 7 if k % 8 else None, k * 37 % 101) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(2)
    want = {k: sorted(v for x, v in rows if x == k) for k, _ in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # groups go over the ends of batches
    try:
        out = divide.solve_groups(df, "k", "v", lambda xs: len(xs) < 2, list, divide.split_at(0.5), divide.merge_sorted, "array<long>")
        assert {r["k"]: r["value"] for r in out.collect()} == want and out.count() == len(want)
        odd = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (1.0, 3)], "k double, v long")
        assert sorted(r["value"] for r in divide.solve_groups(odd, "k", "v", lambda xs: True, len, None, None, "long").collect()) == [1, 2]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no Python call of Spark's for each key
