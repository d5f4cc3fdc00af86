"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import keep


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns ``node`` and ``root``: the smallest node of the component, for every node on a proper edge.

    Alternates the two star operations of Kiveris and others (2014): first every node hands its larger
    neighbours to its smallest one, then its smaller neighbours.  Each step is a partial minimum and an
    equi-join, so no group is gathered in one task, and the number of rounds is logarithmic in practice.
    Null ends and loops are left out; repeated edges count once; without edges the result is empty.
    """
    ends = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"),
                        (F.col(left) != F.col(right)).alias("proper"))
    now = keep(ends.where("proper").select("hi", "lo").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("least"))
        large = (both.join(least, "hi").where("lo > hi and lo <> least")
                 .select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct())
        lower = large.groupBy("hi").agg(F.min("lo").alias("least"))
        handed = large.join(lower, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        now = keep(handed.union(lower.select("hi", F.col("least").alias("lo"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
