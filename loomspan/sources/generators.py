"""Generated inputs. A random value is a digest of its seed and its place, so it is the same on any cluster and in any other engine."""

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_bits(place: Column, seed: int, digits: int) -> Column:
    """So many hexadecimal digits (at most 13) of the MD5 of `seed:place`, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), place.cast("string"))), 1, digits), 16, 10).cast("long")


def uniform(place: Column, seed: int) -> Column:
    """Uniform in (0, 1), from 52 bits."""
    return (digest_bits(place, seed, 13) + 0.5) / float(1 << 52)


def normal(place: Column, seed: int) -> Column:
    """Standard normal, from two uniform values."""
    return F.sqrt(-2 * F.ln(uniform(place, seed))) * F.cos(2 * math.pi * uniform(place, seed + 1_000_003))


def batches(spark: SparkSession, n: int, size: int, value: Column | None = None, seed: int = 0) -> DataFrame:
    """`batch_id, pos, value`: n batches of so many values, uniform in (-1, 1) unless an expression is given."""
    made = uniform(F.col("id"), seed) * 2 - 1 if value is None else value
    return spark.range(n * size).select((F.col("id") / size).cast("long").alias("batch_id"), (F.col("id") % size).cast("int").alias("pos"), made.alias("value"))


def squares(spark: SparkSession, n: int = 1000) -> DataFrame:
    """`id, v` with v = id * id."""
    return spark.range(n).select("id", (F.col("id") * F.col("id")).alias("v"))


def random_ints(spark: SparkSession, n: int, seed: int, kind: str = "int") -> DataFrame:
    """`pos, v`: uniform over the range of 32-bit integers, or over the positive finite range of doubles."""
    v = (digest_bits(F.col("id"), seed, 8) - 2147483648).cast("int") if kind == "int" else uniform(F.col("id"), seed) * 1.7976931348623157e308
    return spark.range(n).select(F.col("id").alias("pos"), v.alias("v"))


def blob_centres(d: int, k: int, seed: int) -> tuple[list[list[float]], list[float]]:
    """Centres uniform in (-100, 100) and deviations uniform in (0, 50)."""
    rng = random.Random(seed)
    return [[rng.uniform(-100, 100) for _ in range(d)] for _ in range(k)], [rng.uniform(0, 50) for _ in range(k)]


def gaussian_blobs(spark: SparkSession, n: int, d: int, k: int, seed: int) -> DataFrame:
    """`point_id, coords, weight`: points around the centres of `blob_centres`, in a cluster chosen uniformly."""
    centres, spread = blob_centres(d, k, seed)
    centres, spread = F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.array(*map(F.lit, spread))
    chosen = spark.range(n).withColumn("c", F.floor(uniform(F.col("id"), seed) * k).cast("int"))
    coords = F.array(*[F.get(F.get(centres, F.col("c")), F.lit(j)) + F.get(spread, F.col("c")) * normal(F.col("id"), seed + 1 + j) for j in range(d)])
    return chosen.select(F.col("id").alias("point_id"), coords.cast("array<float>").alias("coords"), F.lit(1.0).alias("weight"))
