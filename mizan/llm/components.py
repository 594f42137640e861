"""Connected components over a table of links, by joins and minima only: no task holds the links of one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node that can be reached. Nodes without links to others don't appear.

    Alternates large and small stars until the links are stars around the roots. Links may repeat, be of either
    direction or join a node to itself; links with a null end are left out.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b and a is not null and b is not null").distinct()
    now = saved(now, "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.union(least.select("a", "m")).distinct(), "links")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
