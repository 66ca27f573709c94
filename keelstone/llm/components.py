"""Connected components of an edge table, by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.session import drop_stored, stored

MAX_ROUNDS = 60


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of each node to the least node around it."""
    n = _both(e)
    least = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return n.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of those."""
    n = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = n.groupBy("u").agg(F.min("v").alias("m"))
    return n.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v: long); label is the least node reachable.

    Alternates large-star and small-star until no edge changes: each round is two
    aggregations and two joins on node ids, written to the shared folder, and
    ends after about the squared logarithm of the largest component in the worst
    case. Self-loops and repeated edges are allowed; null ends are left out.
    """
    now = stored(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        large = _large_star(now).distinct()
        nxt = stored(_small_star(large).distinct(), "edges")
        seen = nxt.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        drop_stored(now)
        now = nxt
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return stored(now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
