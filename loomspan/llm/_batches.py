"""How much a Python worker is given at once, and what it gives back."""

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch, for jobs on texts: both sides hold a batch or two of each task.
ROWS, BYTES = 2000, 8 << 20
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}


def _number(spark: SparkSession, value: str) -> int:
    """A setting's value, which may have a unit of bytes."""
    return int(value) if value.lstrip("-").isdigit() else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """The session's Arrow batches have at most ROWS rows and about BYTES bytes (one row may have more) for the jobs that run inside, and what they had after them."""
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    try:
        for name, most in _SETTINGS.items():
            if not 0 < _number(spark, before[name]) <= most:
                spark.conf.set(name, str(most))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """What this worker has freed goes to the system: workers outlive their task, and idle ones count in an executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over a task's batches, which gives back its memory behind the last of them."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out
