"""Connected components of a graph given as an edge table, for any size of component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import cut


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Alternating large-star and small-star rounds: each round rewires every node
    to its smallest neighbour, so the number of rounds grows with the logarithm
    of the diameter; they go on until a round changes nothing. The minimum per node is a map-side combined aggregate and
    the join back is on a unique side, so a hub with a third of all edges is
    split by AQE's skew join; no neighbour list is ever gathered.

    ``edges``: columns ``a``, ``b`` (bigint; direction, repeats, nulls and loops
    do not matter, other columns are ignored).
    Returns ``node``, ``component``; an empty table for no edges.
    """
    e = cut(_clean(edges))
    seen = _state(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large-star: larger neighbours of u move to the smallest of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        smaller = large.distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        low = smaller.groupBy("u").agg(F.min("v").alias("m"))
        joined = smaller.join(low, "u")
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(star.where("u <> v").distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
