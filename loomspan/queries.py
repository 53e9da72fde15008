"""Name to query and name to oracle SQL, for the driver and the bench.

Every query takes (spark, sf_dir) and runs over whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import text, vectors
from .operators import divide, grid, kmeans, mapreduce, sorting, windows
from .plans import params
from .sinks import files as sinks
from .sources import files, generators
from .streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
D = "embeddings"
#: Clusters of the k-means queries.
K = 4


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# words and reductions

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split(line, ' ')) AS word FROM ({_LINES})) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return mapreduce.word_count(table(spark, sf_dir, "documents"))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count_ws(spark, sf_dir):
    return mapreduce.word_count(table(spark, sf_dir, "documents"), white_space=True)


@query(f"SELECT substr(word, 1, 1) AS key, max(length(word)) AS value FROM (SELECT unnest(string_split(line, ' ')) AS word FROM ({_LINES})) WHERE word <> '' GROUP BY ALL")
def map_reduce_longest(spark, sf_dir):
    lines = text.lines_of(table(spark, sf_dir, "documents"), "text")
    pairs = lambda line: F.transform(text.words_on_space(line), lambda w: F.struct(F.substring(w, 1, 1).alias("key"), F.length(w).cast("long").alias("value")))
    return mapreduce.map_reduce(lines, pairs, F.max)


@query(ORACLE["word_count"].replace("word,", "word AS key,").replace("AS n", "AS value"))
def word_count_python(spark, sf_dir):
    lines = text.lines_of(table(spark, sf_dir, "documents"), "text")
    return mapreduce.map_reduce_python(lines, lambda line: ((w, 1) for w in line.split(" ") if w), lambda a, b: a + b)


@query("SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS folded FROM events GROUP BY user_id")
def reduce_by_key_ordered(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("letter", F.substring("event_type", 1, 1))
    return mapreduce.reduce_by_key_ordered(events, "user_id", "letter", ["ts", "event_id"], lambda a, b: F.concat(a, b), "folded")


@query("SELECT event_type, string_agg(substr(CAST(event_id AS VARCHAR), 1, 1), '' ORDER BY ts, event_id) AS folded FROM events GROUP BY event_type")
def reduce_by_hot_key_ordered(spark, sf_dir):
    """Few keys with very many rows each: folded run by run."""
    events = table(spark, sf_dir, "events").withColumn("digit", F.substring(F.col("event_id").cast("string"), 1, 1))
    return mapreduce.reduce_by_key_ordered(events, "event_type", "digit", ["ts", "event_id"], lambda a, b: F.concat(a, b), "folded", chunk=1024)


@query("SELECT l_orderkey, l_linenumber, 2 * (l_discount + 1) AS value FROM lineitem")
def map_pipeline(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value"))
    return streams.pipeline(rows, lambda x: x + 1, lambda x: 2 * x)


# windows

_FRAME = "OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_NUMBERED = "row_number() OVER (ORDER BY ts, event_id)"


@query(f"SELECT event_id, round(s, 4) AS window_sum FROM (SELECT event_id, sum(value) {_FRAME} AS s, {_NUMBERED} AS n FROM events) WHERE n >= 10")
def window_sum_k10(spark, sf_dir):
    out = windows.window_reduce(table(spark, sf_dir, "events").select("event_id", "ts", "value"), 10, ["ts", "event_id"], {"s": lambda: F.sum("value")})
    return out.select("event_id", F.round("s", 4).alias("window_sum"))


@query(f"SELECT event_id, s AS window_max FROM (SELECT event_id, max(value) {_FRAME} AS s, {_NUMBERED} AS n FROM events) WHERE n >= 10")
def window_max_k10(spark, sf_dir):
    out = windows.window_reduce(table(spark, sf_dir, "events").select("event_id", "ts", "value"), 10, ["ts", "event_id"], {"window_max": lambda: F.max("value")})
    return out.select("event_id", "window_max")


@query(f"SELECT event_id, s AS folded FROM (SELECT event_id, string_agg(substr(event_type, 1, 1), '') {_FRAME} AS s, {_NUMBERED} AS n FROM events) WHERE n >= 10")
def window_fold_k10_ordered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.substring("event_type", 1, 1).alias("letter"))
    return windows.window_fold(events, 10, ["ts", "event_id"], "letter", "concat(a, b)", "''", "folded").select("event_id", "folded")


@query("SELECT event_id, s AS folded FROM (SELECT event_id, string_agg(substr(event_type, 1, 1), '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n >= 4")
def window_fold_by_user_k4(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.substring("event_type", 1, 1).alias("letter"))
    out = windows.window_fold(events, 4, ["ts", "event_id"], "letter", lambda a, b: F.concat(a, b), F.lit(""), "folded", ["user_id"])
    return out.select("event_id", "folded")


@query(f"SELECT event_id, round(s, 4) AS window_sum FROM (SELECT ts, event_id, sum(value) {_FRAME} AS s, {_NUMBERED} AS n FROM events) WHERE n >= 10 ORDER BY ts DESC, event_id DESC LIMIT 1")
def window_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return windows.latest(events, 10, ["ts", "event_id"], {"s": lambda: F.sum("value")}).select("event_id", F.round("s", 4).alias("window_sum"))


# sorts

_ITEM_ORDER = "l_extendedprice, l_orderkey, l_linenumber"


@query(f"SELECT l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (ORDER BY {_ITEM_ORDER}) - 1 AS pos FROM lineitem")
def sort_global(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return sorting.sort_with_place(rows, ["l_extendedprice", "l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_totalprice, run, row_number() OVER (ORDER BY o_totalprice, run, o_orderkey) - 1 AS pos FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS run FROM orders)")
def merge_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda cond: orders.where(cond).select("o_orderkey", "o_totalprice")
    return sorting.merge_runs(side("o_orderstatus = 'F'"), side("o_orderstatus is distinct from 'F'"), "o_totalprice", "o_orderkey")


@query("SELECT l_quantity, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem) GROUP BY l_quantity")
def equal_ranges(spark, sf_dir):
    return sorting.equal_ranges(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT min(CASE WHEN o_totalprice >= 100000 THEN pos END) AS first_pos, max(CASE WHEN o_totalprice <= 100000 THEN pos END) AS last_pos FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)")
def equal_range(spark, sf_dir):
    return sorting.equal_range(table(spark, sf_dir, "orders"), "o_totalprice", 100000)


@query("SELECT o_orderkey, CAST(sign(o_totalprice - 150000) AS INTEGER) AS part FROM orders")
def partition3(spark, sf_dir):
    return sorting.partition3(table(spark, sf_dir, "orders"), "o_totalprice", 150000).select("o_orderkey", "part")


_FULL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""SELECT pos, previous, value, '[' || array_to_string(around, ',') || ']' AS around FROM (SELECT row_number() OVER w - 1 AS pos, lag(l_quantity) OVER w AS previous, l_quantity AS value,
    list(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {", ".join(_FULL)} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS around FROM lineitem WINDOW w AS (ORDER BY {", ".join(_FULL)})) WHERE value < previous""")
def order_violations(spark, sf_dir):
    out = sorting.order_violations(table(spark, sf_dir, "lineitem").select(*_FULL), "l_quantity", _FULL)
    return out.withColumn("around", vectors.listed(F.col("around").cast("array<bigint>")))


def _sorted_sql(value: str) -> str:
    return f"SELECT bool_and(coalesce(v >= p, true)) AS sorted FROM (SELECT {value} AS v, lag({value}) OVER (ORDER BY o_orderkey) AS p FROM orders)"


@query(_sorted_sql("o_orderkey // 7"))
def is_sorted(spark, sf_dir):
    """A value that follows the order without being it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 7).alias("v"))
    return sorting.is_sorted(orders, "v", ["o_orderkey"])


@query(_sorted_sql("o_totalprice"))
def is_sorted_by_another(spark, sf_dir):
    """Prices do not follow the keys."""
    return sorting.is_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


# parameters and generators


@query("SELECT id, id * id AS v FROM range(1000) t(id)")
def squares(spark, sf_dir):
    return generators.squares(spark)


@query("SELECT i, CAST(sum(id * id) AS BIGINT) AS total FROM (SELECT unnest(range(9, 1000)) AS i), range(1000) t(id) WHERE id BETWEEN i - 9 AND i GROUP BY i")
def squares_window(spark, sf_dir):
    out = windows.window_reduce(generators.squares(spark), 10, ["id"], {"total": lambda: F.sum("v")})
    return out.select(F.col("id").alias("i"), "total")


@query("SELECT (t * 3 + n - 1) * 2 + g // 8 - 1 AS config, t * 10 AS threshold, n AS threads, g AS grain FROM range(3) a(t), range(1, 4) b(n), (VALUES (8), (16)) c(g)")
def param_grid(spark, sf_dir):
    values = params.parse_options(["threshold=[0,10..20]", "threads=[1..3]", "grain=8", "grain=16"], {"threshold": "int", "threads": "int", "grain": "int"})
    return params.grid(spark, values)


@query("SELECT row_number() OVER () - 1 AS ord, v FROM (SELECT unnest([10, 11, 12, 13, 14, 15, 16, 17, 19, 21, 23, 10, 11, 12, 13, 9, 5, 1]) AS v)")
def range_expand(spark, sf_dir):
    return params.values_table(spark, "v", params.parse_options(["v=[10,11..16..17,19..24]", "v=[10..13,9..0]"], {"v": "int"})["v"])


@query("SELECT id // 100 AS batch_id, id % 100 AS pos, 2 * (id + 1) AS value FROM range(50000) t(id)")
def generated_batches(spark, sf_dir):
    return streams.pipeline(generators.batches(spark, 500, 100, F.col("id")), lambda x: x + 1, lambda x: 2 * x)


def _bits(seed: int, digits: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || id), 1, {digits}) AS BIGINT)"


def _uniform(seed: int) -> str:
    return f"(({_bits(seed, 13)} + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


def _normal(seed: int) -> str:
    return f"(sqrt(-2 * ln({_uniform(seed)})) * cos(2 * pi() * {_uniform(seed + 1_000_003)}))"


@query(f"SELECT id // 100 AS batch_id, id % 100 AS pos, round({_uniform(3)} * 2 - 1, 9) AS value FROM range(50000) t(id)")
def generated_uniform(spark, sf_dir):
    return generators.batches(spark, 500, 100, seed=3).withColumn("value", F.round("value", 9))


_CENTRES, _SPREAD = generators.blob_centres(3, 5, 11)


@query(
    f"""SELECT id AS point_id, {", ".join(f"round(CAST(CAST(c[{j + 1}] + s * {_normal(12 + j)} AS FLOAT) AS DOUBLE), 3) AS x{j}" for j in range(3))}, 1::DOUBLE AS weight
    FROM (SELECT id, ({_CENTRES}::DOUBLE[][])[k] AS c, ({_SPREAD}::DOUBLE[])[k] AS s FROM (SELECT id, CAST(floor({_uniform(11)} * 5) AS INTEGER) + 1 AS k FROM range(20000) t(id)))"""
)
def gaussian_blobs(spark, sf_dir):
    made = generators.gaussian_blobs(spark, 20_000, 3, 5, seed=11)
    return made.select("point_id", *[F.round(F.get("coords", F.lit(j)).cast("double"), 3).alias(f"x{j}") for j in range(3)], "weight")


@query(f"SELECT id AS pos, CAST({_bits(5, 8)} - 2147483648 AS INTEGER) AS v FROM range(100000) t(id)")
def random_ints(spark, sf_dir):
    return generators.random_ints(spark, 100_000, seed=5)


# grids

_GRID = (96, 64, -2.0, -1.25, 2.5, 2.5)
_ESCAPE = f"""WITH RECURSIVE px AS (SELECT id // {_GRID[0]} AS row, id % {_GRID[0]} AS col, {_GRID[2]}::DOUBLE + (id % {_GRID[0]}) * {_GRID[4]}::DOUBLE / {_GRID[0]} AS cx, {_GRID[3]}::DOUBLE + (id // {_GRID[0]}) * {_GRID[5]}::DOUBLE / {_GRID[1]} AS cy FROM range({_GRID[0] * _GRID[1]}) t(id)),
it AS (SELECT row, col, cx, cy, 0 AS n, 0::DOUBLE AS re, 0::DOUBLE AS im FROM px UNION ALL
    SELECT row, col, cx, cy, n + 1, (re * re - im * im) + cx, (2 * re) * im + cy FROM it WHERE n < 60 AND re * re + im * im <= 1600),
counts AS (SELECT row, col, max(n) AS n FROM it GROUP BY row, col)"""


def _counts(spark):
    return grid.mandelbrot(grid.pixels(spark, *_GRID), max_iter=60)


@query(f"{_ESCAPE} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, n FROM counts")
def mandelbrot_counts(spark, sf_dir):
    return _counts(spark)


_MANY = f"{_ESCAPE}, scaled AS (SELECT {_GRID[1] - 1} - row AS row, col, n * 25 AS n FROM counts)"


@query(f"""{_MANY} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(CASE n // 256 WHEN 0 THEN n WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN n - 768 ELSE 255 END AS INTEGER) AS r,
    CAST(CASE n // 256 WHEN 0 THEN 0 WHEN 1 THEN n - 256 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN n - 1024 ELSE 255 END AS INTEGER) AS g, CAST(CASE n // 256 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN n - 512 ELSE 255 END AS INTEGER) AS b FROM scaled""")
def mandelbrot_colours(spark, sf_dir):
    image = grid.flipped(_counts(spark), _GRID[1]).withColumn("n", F.col("n") * 25)
    return grid.colours(image).select("row", "col", "r", "g", "b")


@query(f"""{_ESCAPE}, tiles AS (SELECT (row // 16) * 6 + col // 16 AS tile, sum(n) AS total FROM counts GROUP BY 1),
    owners AS (SELECT CAST(tile % 5 AS INTEGER) AS owner, count(*) AS tiles, CAST(sum(total) AS BIGINT) AS total FROM tiles GROUP BY 1) SELECT owner, tiles, total, (SELECT max(total) FROM owners) AS most FROM owners""")
def tile_stats(spark, sf_dir):
    return grid.tile_stats(_counts(spark), 16, _GRID[0], 5)


@query("""WITH RECURSIVE cf AS (SELECT t * 12 + n * 4 + p * 2 + g AS config, 20 + 20 * t AS threshold, 2 + n AS threads, 32 + 32 * p AS pixelX, 32 AS pixelY, 8 + 8 * g AS grain FROM range(2) a(t), range(3) b(n), range(2) c(p), range(2) d(g)),
sizes AS (SELECT DISTINCT threshold, pixelX, pixelY FROM cf),
px AS (SELECT threshold, pixelX, y AS row, x AS col, -2::DOUBLE + x * 2.5::DOUBLE / pixelX AS cx, -1.25::DOUBLE + y * 2.5::DOUBLE / pixelY AS cy FROM sizes, range(64) u(x), range(32) v(y) WHERE x < pixelX),
it AS (SELECT *, 0 AS n, 0::DOUBLE AS re, 0::DOUBLE AS im FROM px UNION ALL SELECT threshold, pixelX, row, col, cx, cy, n + 1, (re * re - im * im) + cx, (2 * re) * im + cy FROM it WHERE n < threshold AND re * re + im * im <= 1600),
counts AS (SELECT threshold, pixelX, row, col, max(n) AS n FROM it GROUP BY ALL),
tiles AS (SELECT config, (row // grain) * (pixelX // grain) + col // grain AS tile, sum(n) AS total FROM cf JOIN counts USING (threshold, pixelX) GROUP BY ALL),
owners AS (SELECT config, CAST(tile % threads AS INTEGER) AS owner, count(*) AS tiles, CAST(sum(total) AS BIGINT) AS total FROM tiles JOIN cf USING (config) GROUP BY ALL)
SELECT config, threshold, threads, pixelX, pixelY, grain, owner, tiles, total, max(total) OVER (PARTITION BY config) AS most FROM owners JOIN cf USING (config)""")
def fractal_sweep(spark, sf_dir):
    values = {"threshold": [20, 40], "threads": [2, 3, 4], "pixelX": [32, 64], "pixelY": [32], "grain": [8, 16], "X": [-2.0], "Y": [-1.25], "sizeX": [2.5], "sizeY": [2.5]}
    return params.fractal_sweep(spark, values).drop("X", "Y", "sizeX", "sizeY")


# k-means


def _points(spark, sf_dir):
    return kmeans.points(table(spark, sf_dir, D), "vec_id", "embedding")


_X = f"x AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS v FROM {D})"
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _rounds(n: int, start: str = f"point_id % {K}") -> str:
    """CTEs a0, c0, a1, c1 ... an: assignments and centres of n rounds (without repairs)."""
    out = [_X, f"a0 AS MATERIALIZED (SELECT point_id, CAST({start} AS INTEGER) AS cluster_id, 0::DOUBLE AS dist FROM x)"]
    for r in range(n):
        out.append(f"c{r} AS MATERIALIZED (SELECT cluster_id, list(m ORDER BY j) AS c FROM (SELECT cluster_id, j, avg(e) AS m FROM (SELECT cluster_id, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM x JOIN a{r} USING (point_id)) GROUP BY ALL) GROUP BY cluster_id)")
        out.append(f"a{r + 1} AS MATERIALIZED (SELECT point_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS dist FROM (SELECT point_id, cluster_id, {_DIST.format(a='v', b='c')} AS d FROM x CROSS JOIN c{r}) GROUP BY point_id)")
    return ", ".join(out)


_SEEDS = f"seeds AS (SELECT CAST(row_number() OVER (ORDER BY point_id) - 1 AS INTEGER) AS cluster_id, v AS c FROM (SELECT * FROM x WHERE point_id < {K}))"
_NEAREST = f"near AS (SELECT point_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS dist FROM (SELECT point_id, cluster_id, {_DIST.format(a='v', b='c')} AS d FROM x CROSS JOIN seeds) GROUP BY point_id)"


def _near(spark, sf_dir):
    """Points by the nearest of the K points with the least ids."""
    points = _points(spark, sf_dir)
    seeds = [r["coords"] for r in points.where(F.col("point_id") < K).orderBy("point_id").limit(K).collect()]
    return points, kmeans.assign_expr(points, seeds)


@query(f"WITH {_X}, {_SEEDS}, {_NEAREST} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM near")
def nearest_centroid(spark, sf_dir):
    return _near(spark, sf_dir)[1].withColumn("dist", F.round("dist", 6))


@query(f"WITH {_X}, {_SEEDS}, {_NEAREST} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM near")
def nearest_centroid_arrow(spark, sf_dir):
    points = _points(spark, sf_dir)
    seeds = [r["coords"] for r in points.where(F.col("point_id") < K).orderBy("point_id").limit(K).collect()]
    return kmeans.assign(points, seeds).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_X} SELECT a.point_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 3)), 6) AS d3 FROM x a JOIN x b ON b.point_id = a.point_id + 1")
def ln_distance(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select((F.col("point_id") - 1).alias("point_id"), F.col("coords").alias("q"))
    return p.join(q, "point_id").select("point_id", F.round(vectors.distance(F.col("coords"), F.col("q"), 3), 6).alias("d3"))


@query(f"SELECT label AS cluster_id, CAST(j - 1 AS INTEGER) AS pos, round(avg(e), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) AS j FROM {D}) GROUP BY ALL")
def centroid_mean(spark, sf_dir):
    return kmeans.cluster_means(table(spark, sf_dir, D), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_X}, {_SEEDS}, {_NEAREST} SELECT round(sum(dist), 4) AS inertia FROM near")
def inertia(spark, sf_dir):
    return kmeans.inertia(_near(spark, sf_dir)[1]).withColumn("inertia", F.round("inertia", 4))


@query(f"WITH {_X}, {_SEEDS}, {_NEAREST} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM near WHERE cluster_id IN (SELECT cluster_id FROM near GROUP BY 1 HAVING count(*) > 1) ORDER BY near.dist DESC, point_id LIMIT 1")
def farthest_point(spark, sf_dir):
    return kmeans.farthest_point(_near(spark, sf_dir)[1]).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_X}, {_SEEDS}, {_NEAREST} SELECT CAST(sum(CAST(cluster_id <> point_id % {K} AS INTEGER)) AS BIGINT) AS changed, bool_or(cluster_id <> point_id % {K}) AS any_changed FROM near")
def changed_count(spark, sf_dir):
    points, near = _near(spark, sf_dir)
    return kmeans.changed_count(near, points.select("point_id", kmeans.round_robin(K).alias("cluster_id")))


def _clustered(points, found):
    return kmeans.assign(points, found.centres, found.moved).withColumn("dist", F.round("dist", 6))


def _converged(points, found):
    if not found.converged:
        raise ValueError(f"k-means has not converged after {found.rounds} rounds")
    return _clustered(points, found)


@query(f"WITH {_rounds(3)} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM a3")
def kmeans_roundrobin_3iter(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _clustered(points, kmeans.kmeans(points, K, kmeans.round_robin(K), max_iter=3))


#: Rounds of the unrolled oracle; a converged assignment stays as it is.
_UNROLLED = 40


@query(f"WITH {_rounds(_UNROLLED)} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM a{_UNROLLED}")
def kmeans_converged(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _converged(points, kmeans.kmeans(points, K, kmeans.round_robin(K)))


def _tolerance_sql() -> str:
    n = 15
    inertias = " UNION ALL ".join(f"SELECT {r} AS r, sum(dist) AS i FROM a{r}" for r in range(1, n + 1))
    rows = " UNION ALL ".join(f"SELECT {r} AS r, * FROM a{r}" for r in range(2, n + 1))
    return f"""WITH {_rounds(n)}, i AS ({inertias}), stop AS (SELECT min(b.r) AS r FROM i a JOIN i b ON b.r = a.r + 1 WHERE a.i - b.i <= 0.01 * b.i)
        SELECT point_id, cluster_id, round(dist, 6) AS dist FROM ({rows}) WHERE r = (SELECT r FROM stop)"""


@query(_tolerance_sql())
def kmeans_tol(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _clustered(points, kmeans.kmeans(points, K, kmeans.round_robin(K), tolerance=0.01))


def _trials_sql() -> str:
    start = lambda t: f"((((point_id * 1103515245 + {12345 * (t + 1)}) & 2147483647) >> 8) % {K})"
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_rounds(3, start(t))} SELECT {t} AS trial, point_id, cluster_id, round(dist, 6) AS dist FROM a3)" for t in range(2))


@query(_trials_sql())
def kmeans_trials(spark, sf_dir):
    points = _points(spark, sf_dir)
    made = [_clustered(points, c).withColumn("trial", F.lit(t)) for t, c in kmeans.trials(points, K, 2, parallel=2, max_iter=3)]
    return made[0].union(made[1]) if len(made) == 2 else made[0]


@query()
def kmeans_trials_converged(spark, sf_dir):
    """kmeans_trials, whose SQL unrolls three rounds, until no assignment changes."""
    points = _points(spark, sf_dir)
    made = [_converged(points, c).withColumn("trial", F.lit(t)) for t, c in kmeans.trials(points, K, 2, parallel=2)]
    return made[0].union(made[1]) if len(made) == 2 else made[0]


@query(f"WITH {_rounds(3)} SELECT point_id, 0 AS trial, cluster_id, round(dist, 6) AS dist, round(v[1], 6) AS first_coord FROM a3 JOIN x USING (point_id)")
def cluster_report_join(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = kmeans.kmeans(points, K, kmeans.round_robin(K), max_iter=3)
    path = scratch.new_path(spark, "report")
    sinks.cluster_report(kmeans.assign(points, found.centres, found.moved), found, path, {"centroids": K, "trials": 1})
    joined = sinks.positional_join(points, files.report_blocks(spark, path))
    return joined.select("point_id", "trial", "cluster_id", F.round("dist", 6).alias("dist"), F.round(F.get("coords", F.lit(0)), 6).alias("first_coord"))


# streams


@query("SELECT event_id, 2 * (value + 1) AS value FROM events")
def stream_map(spark, sf_dir):
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "value")
    return streams.run_to_table(streams.pipeline(stream, lambda x: x + 1, lambda x: 2 * x), "stream-map")


@query(ORACLE["word_count"])
def stream_word_count(spark, sf_dir):
    return streams.run_complete(streams.stream_word_count(streams.file_stream(spark, f"{sf_dir}/documents.parquet")), "stream-words")


@query("SELECT user_id, ts, event_id, round(s, 4) AS result FROM (SELECT user_id, ts, event_id, sum(value) OVER w AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n >= 10")
def stream_window_k10(spark, sf_dir):
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet")
    out = streams.run_to_table(streams.count_windows(stream, 10, "user_id", ["ts", "event_id"], "value", "sum"), "stream-window")
    return out.withColumn("result", F.round("result", 4))


# divide and conquer


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem")
def dac_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return divide.tree_fold(rows, ["l_orderkey", "l_linenumber"], "q", lambda a, b: a + b)


@query("SELECT o_custkey, array_to_string(list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_totalprice), ',') AS value FROM orders GROUP BY o_custkey")
def dac_sort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("x"))
    out = divide.solve_groups(orders, "o_custkey", "x", lambda xs: len(xs) < 2, list, divide.split_at(0.5), divide.merge_sorted, "array<long>")
    return out.select("o_custkey", F.array_join("value", ",").alias("value"))


@query("SELECT o_orderpriority AS key, count(*) AS n, '[' || string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) || ']' AS listed FROM orders GROUP BY 1")
def listed_values(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    return grouped.select("key", "n", vectors.listed(F.col("s")).alias("listed"))


@query("SELECT word || ' ' || n AS value FROM (" + ORACLE["word_count"] + ")")
def word_count_text(spark, sf_dir):
    path = scratch.new_path(spark, "words")
    sinks.key_value_text(word_count(spark, sf_dir), "word", "n", path)
    return spark.read.schema("value string").text(path)


# files, written and read back


def _lines(spark, df: DataFrame, name: str) -> str:
    """The path of a text folder with the column `value`."""
    path = scratch.new_path(spark, name)
    df.select("value").write.text(path)
    return path


@query("SELECT count(*) AS n, min(line_no) AS first, max(line_no) AS last, count(DISTINCT value) AS kinds FROM (SELECT n_name AS value, row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no FROM nation)")
def text_lines_back(spark, sf_dir):
    """Lines of one file with their places; nation has as many rows at every size."""
    path = _lines(spark, table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1), "names")
    got = files.text_lines(spark, path)
    return got.agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count_distinct("value").alias("kinds"))


@query("SELECT CAST(c_nationkey AS DOUBLE) AS x, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 2) AS y, 1::DOUBLE AS weight FROM customer")
def point_file_back(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat_ws(" \t", F.col("c_nationkey"), F.col("c_acctbal")).alias("value"))
    got = files.point_file(spark, _lines(spark, lines, "points"))
    return got.select(F.get("coords", F.lit(0)).cast("double").alias("x"), F.round(F.get("coords", F.lit(1)).cast("double"), 2).alias("y"), "weight")


def _key_files(spark, sf_dir) -> str:
    path = scratch.new_path(spark, "keys")
    sinks.sorted_files(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("v"), "o_orderkey"), ["v", "o_orderkey"], path)
    return path


@query("SELECT 2 * place + side AS pos, CAST(CASE side WHEN 0 THEN v ELSE o_orderkey END AS INTEGER) AS v FROM (SELECT o_custkey AS v, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders), range(2) r(side)")
def int_file_back(spark, sf_dir):
    """Sorted rows as text in global order, read as integers in the order of the files."""
    return files.int_file(spark, _key_files(spark, sf_dir))


@query("SELECT o_orderstatus AS status, o_custkey || ' ' || o_orderkey AS value FROM orders")
def sorted_files_back(spark, sf_dir):
    path = scratch.new_path(spark, "sorted")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    sinks.sorted_files(orders, ["o_custkey", "o_orderkey"], path, ["o_orderstatus"])
    return spark.read.schema("value string, o_orderstatus string").text(path).select(F.col("o_orderstatus").alias("status"), "value")


@query("SELECT n_nationkey AS size, n_regionkey * 0.5::DOUBLE AS chrono, n_name AS parameters FROM nation, range(2)")
def report_csv_back(spark, sf_dir):
    """Report rows, added twice."""
    path = scratch.new_path(spark, "report")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("size"), (F.col("n_regionkey") * 0.5).alias("chrono"), F.col("n_name").alias("parameters"))
    for _ in range(2):
        sinks.report_csv(rows, path, ["size", "chrono", "parameters"])
    return spark.read.schema("size int, chrono double, parameters string").csv(path, sep=";", header=True)


@query(f"WITH {_rounds(3)} SELECT 0 AS trial, cluster_id, count(*) AS n FROM a3 GROUP BY ALL")
def plot_files_back(spark, sf_dir):
    """Points of each cluster, counted in the plot files that a point file and a report give."""
    points = _points(spark, sf_dir)
    found = kmeans.kmeans(points, K, kmeans.round_robin(K), max_iter=3)
    report, out = scratch.new_path(spark, "report"), scratch.new_path(spark, "plot")
    sinks.cluster_report(kmeans.assign(points, found.centres, found.moved), found, report)
    lines = points.orderBy("point_id").select(F.concat_ws(" ", F.col("coords").cast("array<string>")).alias("value"))
    sinks.plot_files(spark, _lines(spark, lines, "points"), report, out)
    got = spark.read.schema("value string, trial int").text(out)
    return got.groupBy("trial", F.element_at(F.split("value", " "), -1).cast("int").alias("cluster_id")).agg(F.count("*").alias("n"))


@query(f"WITH {_rounds(3, 'CASE WHEN point_id = (SELECT min(point_id) FROM x) THEN 1 ELSE 0 END')} SELECT point_id, cluster_id, round(dist, 6) AS dist FROM a3")
def kmeans_repair(spark, sf_dir):
    """All points start in one of two clusters, so the point of least id is moved to the empty one."""
    points = _points(spark, sf_dir)
    return _clustered(points, kmeans.kmeans(points, 2, F.lit(0), max_iter=3))


@query(f"SELECT event_id, s AS folded FROM (SELECT event_id, CAST(sum(user_id) {_FRAME} AS BIGINT) AS s, {_NUMBERED} AS n FROM events) WHERE n >= 10")
def window_fold_from_file(spark, sf_dir):
    """The operation is SQL text in a file that is read at run time."""
    text_of = spark.createDataFrame([("-- sum of the window",), ("a + b",)], "value string").coalesce(1)
    op = windows.read_operator(spark, _lines(spark, text_of, "operator"))
    return windows.window_fold(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 10, ["ts", "event_id"], "user_id", op, "cast(0 as bigint)", "folded").select("event_id", "folded")


@query(f"""WITH {_X}, y AS (SELECT a.point_id, a.v AS p, b.v AS q, 1 + a.point_id % 3 AS w FROM x a JOIN x b ON b.point_id = a.point_id + 1),
    z AS (SELECT *, list_transform(list_zip(p, q), lambda r: r[1] + r[2]) AS plus, list_transform(list_zip(p, q), lambda r: r[1] - r[2]) AS less, list_transform(p, lambda e: e / w) AS m FROM y)
    SELECT point_id, round(list_sum(list_transform(list_zip(m, q), lambda r: (r[1] - r[2]) * (r[1] - r[2]))), 6) AS weighted, round(list_sum(plus), 6) AS added, round(list_sum(less), 6) AS subtracted, round(list_sum(m), 6) AS normalised,
    CAST(len(p) AS INTEGER) AS zeros, CASE WHEN point_id = 0 THEN 0 ELSE CAST(2 ** length(bin(point_id)) AS BIGINT) - 1 END AS all_ones, true AS in_range, point_id % 2 = 0 AS named FROM z""")
def vector_functions(spark, sf_dir):
    p = _points(spark, sf_dir)
    both = p.join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("coords").alias("q")), "point_id").withColumn("w", (1 + F.col("point_id") % 3).cast("double"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    p, q, w, i = F.col("coords"), F.col("q"), F.col("w"), F.col("point_id")
    bucket = vectors.bucket_of(i, 7)
    option = F.concat(F.when(i % 2 == 0, F.lit("seed=")).otherwise(F.lit("seeds=")), i)
    return both.select("point_id", F.round(vectors.weighted_distance(p, w, q, F.lit(1.0)), 6).alias("weighted"), total(vectors.added(p, q)).alias("added"), total(vectors.subtracted(p, q)).alias("subtracted"), total(vectors.normalised(p, w)).alias("normalised"),
        F.size(vectors.zeros(F.size(p))).alias("zeros"), vectors.all_ones(i).alias("all_ones"), ((bucket >= 0) & (bucket < 7) & (bucket == vectors.bucket_of(i + 0, 7))).alias("in_range"), text.starts_with_name(option, "seed").alias("named"))


@query("SELECT n AS threads, 4 * t AS threshold, (SELECT 2 * count(*) FROM orders) AS size, 'ratio=2:3' AS parameters FROM range(1, 3) a(n), range(2) b(t)")
def sort_experiment(spark, sf_dir):
    """Every setting of the sort experiment; its report is read back without the times."""
    report = scratch.new_path(spark, "report")
    options = params.parse_options([f"input={_key_files(spark, sf_dir)}", "threads=[1..2]", "threshold=[0,4]", "ratio=2:3", f"report={report}"], params.SORT_OPTIONS)
    params.sort_experiment(spark, options)
    return spark.read.schema("threads int, size long, threshold int, chrono double, parameters string").csv(report, sep=";", header=True).drop("chrono")
