"""Connected components by alternating large-star and small-star."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written


class Joined:
    """Groups that are joined one by one, for the few members of a block."""

    def __init__(self) -> None:
        self.over: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.over.get(x, x)) != x:
            self.over[x] = x = self.over.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.over[max(a, b)] = min(a, b)
        return a != b


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """`node, component`: for each node of `edges (a, b)` the smallest node that it reaches.

    Each round is two joins on a node with its smallest neighbour; nothing of it is collected but
    one count. Rounds stop when every component is a star around its smallest node (about log n of
    them). Loops and repeated edges are allowed, edges with a null end are left out, no edges give
    an empty table.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct(), name)
    while _unsettled(e):
        old = e
        e = written(_small_star(_large_star(e)), name)
        drop(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _unsettled(e: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or both a smaller and a larger one: else all components are stars around their smallest node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return bool(bad.agg(F.count("*")).first()[0])


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
