"""Parameter texts with ranges, their tables, and sweeps over all combinations."""

import re
import time
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS: dict[str, Callable] = {"int": int, "float": float, "double": float, "string": str}
_NUMBER = {"int": re.compile(r"-?[0-9]+"), "float": re.compile(r"-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"), "string": re.compile(r"[^,\[\]]+")}
_NUMBER["double"] = _NUMBER["float"]


def parse_values(text: str, kind: str = "int") -> list:
    """The values of `v`, or of `[v,a..b,c,d..e]`.

    `a..b` goes to b by steps of 1; after a comma, `c,d..e` goes on from d by steps of d - c (of 1
    if they are equal). A step that leads away from the end changes its sign. The end is never
    passed. Strings have no ranges.
    """
    number, make = _NUMBER[kind], _KINDS[kind]
    if not text.startswith("["):
        if not number.fullmatch(text):
            raise ValueError(f"not a value of type {kind}: {text}")
        return [make(text)]
    if not text.endswith("]"):
        raise ValueError(f"no closing bracket: {text}")
    out: list = []
    at, end, separator = 1, len(text) - 1, ""
    while at < end:
        found = number.match(text, at)
        if not found or found.end() > end:
            raise ValueError(f"no value of type {kind} at {at}: {text}")
        v, at = make(found[0]), found.end()
        if separator == "..":
            step = out[-1] - out[-2] if before == "," and len(out) > 1 else 0
            out.extend(_steps(out[-1], v, step))
        else:
            out.append(v)
        before = separator
        if at < end:
            separator = ".." if text.startswith("..", at) and kind != "string" else text[at]
            if separator not in ("..", ","):
                raise ValueError(f"neither a comma nor a range at {at}: {text}")
            at += len(separator)
            if at >= end:
                raise ValueError(f"ends with {separator}: {text}")
    return out


def _steps(start, end, step) -> list:
    step = abs(step) or 1
    if end < start:
        step = -step
    out, k = [], 1
    while (start + k * step <= end) if step > 0 else (start + k * step >= end):
        out.append(start + k * step)
        k += 1
    return out


def parse_options(arguments: Iterable[str], kinds: dict[str, str], assign: str = "=") -> dict[str, list]:
    """Values by name from `name=values` texts; a name may come again and adds to its values. The symbol may be empty."""
    out: dict[str, list] = {}
    for text in arguments:
        names = [n for n in kinds if text.startswith(n + assign)]
        if not names:
            raise ValueError(f"unknown option: {text}")
        name = max(names, key=len)
        out.setdefault(name, []).extend(parse_values(text[len(name + assign) :], kinds[name]))
    return out


def _kind(values: list) -> str:
    return "string" if isinstance(values[0], str) else "double" if any(isinstance(v, float) for v in values) else "bigint"


def values_table(spark: SparkSession, name: str, values: list) -> DataFrame:
    """`ord, <name>`: the values of one parameter in order."""
    kind = _kind(values)
    rows = [(k, float(v) if kind == "double" else v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ord long, {name} {kind}")


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """Every combination of parameter values, with `config` numbered in nested-loop order, the last name fastest.

    A configuration's values are looked up by its number, so nothing is joined.
    """
    size, columns = 1, {}
    for name, values in reversed(parameters.items()):
        place = F.pmod(F.floor(F.col("config") / size), F.lit(len(values))).cast("int")
        columns[name] = F.get(F.array(*map(F.lit, values)), place).cast(_kind(values))
        size *= len(values)
    return spark.range(size).select(F.col("id").alias("config")).select("config", *[columns[n].alias(n) for n in parameters])


def sweep(parameters: dict[str, list], run: Callable[..., bool | None]) -> list[dict]:
    """Runs a function for every combination in nested-loop order with its time in ms; stops after one that returns False."""
    rows = []
    for values in product(*parameters.values()):
        chosen = dict(zip(parameters, values))
        began = time.perf_counter()
        result = run(**chosen)
        rows.append(chosen | {"chrono": (time.perf_counter() - began) * 1000})
        if result is False:
            break
    return rows


#: Numbers that one range of the sort experiment is for (about 100 MB of a task's memory).
RANGE = 1 << 21

#: Options of the sort experiment; `result`, `report` and `log` are the same as with `.file`.
SORT_OPTIONS = {"threads": "int", "threshold": "int", "input": "string", "ratio": "string", "chrono": "int", "result": "string", "result.file": "string", "report": "string", "report.file": "string", "log": "string", "log.file": "string", "log.dim": "int"}


def parse_ratio(text: str) -> tuple[int, int]:
    """The two parts of `alpha:beta`, by which a run is divided."""
    found = re.fullmatch(r"([0-9]+):([0-9]+)", text)
    if not found or not int(found[1]) or not int(found[2]):
        raise ValueError(f"not a ratio alpha:beta of positive numbers: {text}")
    return int(found[1]), int(found[2])


def _one(options: dict[str, list], name: str):
    """The last value of an option or of its `.file` form; None if neither is given."""
    found = [*options.get(name, []), *options.get(name + ".file", [])]
    return found[-1] if found else None


def sort_experiment(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """`input, threads, threshold, size, chrono, parameters`: sorts each input for each setting.

    `threads` sets the number of ranges; inputs of more than RANGE numbers a thread get more of them, so
    that no task's memory grows with the input. The places of an input's numbers are found once, before
    the sorts are timed. Thresholds and ratios (where and how a recursion would
    divide) change nothing here but the row's `parameters`, as ranges are sampled. Options: `result`
    names a folder for the sorted numbers of the last setting, `report` one to which report rows are
    added (with `chrono=0` without times), `log` a text folder with a line for each sort; `log.dim`
    says how many of the sorted numbers it shows.
    """
    from ..sinks.files import report_csv
    from ..sources.files import int_file

    unknown = [n for n in options if n not in SORT_OPTIONS]
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    ratio = ":".join(map(str, parse_ratio(options["ratio"][-1]))) if options.get("ratio") else "1:1"
    result, report, log = (_one(options, n) for n in ("result", "report", "log"))
    shown = (options.get("log.dim") or [0])[-1]
    rows, notes = [], []
    inputs = {path: int_file(spark, path) for path in options["input"]}
    sizes = {path: data.count() for path, data in inputs.items()}

    def run(input: str, threshold: int, threads: int) -> None:
        data = inputs[input]
        rows.append(sizes[input])
        sorted_ = data.repartitionByRange(max(1, threads, -(-rows[-1] // RANGE)), "v", "pos").sortWithinPartitions("v", "pos")
        if result:
            sorted_.select(F.col("v").cast("string")).write.mode("overwrite").text(result)
        else:
            sorted_.write.format("noop").mode("overwrite").save()
        if log:
            first = [str(r["v"]) for r in data.orderBy("v", "pos").limit(shown).collect()] if shown else []
            notes.append((f"input={input} threads={threads} threshold={threshold} size={rows[-1]}" + "".join(" " + x for x in first),))

    chosen = {"input": options["input"], "threshold": options.get("threshold", [0]), "threads": options.get("threads", [1])}
    timed = sweep(chosen, run)
    made = [(r["input"], r["threads"], r["threshold"], n, r["chrono"], f"ratio={ratio}") for r, n in zip(timed, rows)]
    out = spark.createDataFrame(made, "input string, threads int, threshold int, size long, chrono double, parameters string")
    if report:
        wanted = ["threads", "size", "threshold", "chrono", "parameters"]
        report_csv(out, report, [c for c in wanted if c != "chrono" or (options.get("chrono") or [1])[-1]])
    if log:
        spark.createDataFrame(notes, "value string").coalesce(1).write.mode("overwrite").text(log)
    return out


#: Parameters of a fractal configuration, and those that have a value of their own where none is given.
FRACTAL = ["threshold", "threads", "pixelX", "pixelY", "grain", "X", "Y", "sizeX", "sizeY"]


def fractal_sweep(spark: SparkSession, parameters: dict[str, list], max_iter: int = 100) -> DataFrame:
    """`config, owner, tiles, total, most` and the parameters: tile statistics of a fractal for every combination of FRACTAL.

    `threshold` is the bound on iterations (`max_iter` if it isn't given), `threads` the owners that
    tiles are dealt to (4). One plan for all combinations: each row of their table makes its own pixels.
    """
    from ..operators.grid import BOUND2, escape_counts_of

    given = {"threshold": [max_iter], "threads": [4]} | parameters
    unknown = [n for n in given if n not in FRACTAL]
    if unknown:
        raise ValueError(f"not parameters of a fractal: {', '.join(unknown)}")
    names = [n for n in FRACTAL if n in given]
    configs = grid(spark, {n: given[n] for n in names}).select("config", *names)
    rows = configs.select("*", F.explode(F.sequence(F.lit(0), F.col("pixelY").cast("int") - 1)).alias("row"))
    # one configuration's rows of pixels are dealt to many tasks
    rows = rows.repartition("config", "row")
    pixels = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("pixelX").cast("int") - 1)).alias("col"))
    cx = F.col("X").cast("double") + F.col("col") * F.col("sizeX").cast("double") / F.col("pixelX")
    cy = F.col("Y").cast("double") + F.col("row") * F.col("sizeY").cast("double") / F.col("pixelY")
    counts = pixels.withColumn("n", escape_counts_of(cx, cy, F.col("threshold").cast("int"), F.lit(BOUND2)))
    across = F.ceil(F.col("pixelX") / F.col("grain"))
    tile = F.floor(F.col("row") / F.col("grain")) * across + F.floor(F.col("col") / F.col("grain"))
    by_tile = counts.groupBy("config", *names, tile.alias("tile")).agg(F.sum(F.col("n").cast("long")).alias("total"))
    by_owner = by_tile.groupBy("config", *names, (F.col("tile") % F.col("threads")).cast("int").alias("owner")).agg(F.count("*").alias("tiles"), F.sum("total").alias("total"))
    most = by_owner.groupBy("config").agg(F.max("total").alias("most"))
    return by_owner.join(most, "config").select("config", *names, "owner", "tiles", "total", "most")
