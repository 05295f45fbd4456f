"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import staged


def connected_components(links: DataFrame, owner: str = "", most_rounds: int = 60) -> DataFrame:
    """Labels every end of ``links`` (a, b: long) with the smallest id that it reaches: (node, component).

    Alternates the large-star and small-star steps: each node hangs its larger neighbours, then its smaller ones, on
    its smallest neighbour. Links only ever point to smaller ids, so the tables never outgrow the links, and the depth
    falls about as the logarithm of the longest chain. Each round is written to the shared folder. Links that repeat,
    loops and an empty table are fine; null ends are left out.
    """
    down = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = staged(links.where("a <> b").select(*down(F.col("a"), F.col("b"))).distinct(), "links", owner)
    state = _summary(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("x"))
        small = small.select(F.col("x.lo").alias("hi"), F.col("x.m").alias("lo")).where("hi <> lo").distinct()
        edges = staged(small, "stars", owner)
        if (now := _summary(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _summary(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: a count and two order-free sums of hashes."""
    wide = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), wide, F.sum(F.hash("lo", "hi").cast("long"))).first())
