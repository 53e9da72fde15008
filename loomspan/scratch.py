"""Tables written between steps, in the folder that all executors share.

`spark.checkpoint.dir` names that folder; the session's setting is read and only where it is
unset (tests, a laptop) a temporary folder of the driver's is taken. A written table cuts the
lineage and survives lost executors, unlike a local checkpoint.
"""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; it is deleted when the driver ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and no later step reads."""
    for t in tables:
        path = getattr(t, "_loomspan_path", None)
        if path:
            _delete(t.sparkSession, path)
            _MADE[:] = [x for x in _MADE if x[1] != path]


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What a job inside shuffled is deleted at its end; by Spark's default it stays until the driver happens to collect its garbage.

    For tables that are written: a second action on the same frame would have to shuffle again.
    """
    before = spark.conf.get(_SWEEP)
    try:
        spark.conf.set(_SWEEP, "true")
        yield
    finally:
        spark.conf.set(_SWEEP, before)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that are made inside are deleted at its end, but for those put in the list: for a result that is written there."""
    before, keep = {path for _, path in _MADE}, []
    yield keep
    kept = {getattr(t, "_loomspan_path", None) for t in keep}
    for spark, path in [x for x in _MADE if x[1] not in before | kept]:
        _delete(spark, path)
        _MADE.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return
