"""Connected components of a graph given by its edges, as Spark jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scoreloom.llm.common import cut

#: A round has so many tasks at least, and one more for each so many edges.
LEAST_PARTS, PART_ROWS = 24, 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node of an edge, component being the least id reachable.

    Alternating stars: each round links a node's larger neighbours, then its smaller ones, to the least
    id next to it. Minima are aggregated before the shuffle, so that a hub's edges aren't gathered, and each
    round's edges are checkpointed. The rounds grow with the logarithm of the number of nodes and
    end when nothing changes.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    def sign(df: DataFrame) -> Row:
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    last = sign(now)
    while True:
        # tasks follow the number of edges, which only falls: a small graph takes few
        parts = max(LEAST_PARTS, math.ceil(2 * last["n"] / PART_ROWS))
        # large star: neighbours above u go to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        # small star: u and its neighbours below go to the least of these
        down = big.where("u > v")
        low = least(down)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small.coalesce(parts))
        mark = sign(now)
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
