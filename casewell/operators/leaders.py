"""Greedy leader clustering on a cluster.

The sequential rule: walk the items in order; an item not yet taken becomes a
leader and takes every later free item similar to it.  The leaders are the
lexicographically first maximal independent set of the similarity graph, and a
member belongs to its first leader.  That is computed without ever holding the
graph or a group in one place:

* items are taken in growing prefixes of the order;
* inside a prefix, every item without an earlier undecided neighbour is a leader
  at once and takes its neighbours, in parallel, until no edge is left
  (Blelloch, Fineman and Shun, SPAA 2012);
* the prefix' leaders then take members from all the rest, so the rest is only
  ever compared with leaders, never with itself.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from casewell.settings import ensure_checkpoint_dir

EdgeSearch = Callable[[DataFrame, DataFrame, bool], DataFrame]
FIRST_PREFIX = 4_000
GROWTH = 4


def _taken(edges: DataFrame) -> DataFrame:
    """Nodes that are not leaders, from edges (l before r) inside one prefix."""
    taken = None
    alive = edges.select("l_ord", "r_ord")
    while True:
        followers = alive.select(F.col("r_ord").alias("l_ord")).distinct()
        heads = alive.select("l_ord").distinct().join(followers, "l_ord", "left_anti")
        hit = alive.join(heads, "l_ord", "left_semi").select("r_ord").distinct().checkpoint()
        taken = hit if taken is None else taken.unionByName(hit)
        gone = hit.select(F.col("r_ord").alias("l_ord"))
        alive = (alive.join(heads, "l_ord", "left_anti").join(gone, "l_ord", "left_anti")
                 .join(hit, "r_ord", "left_anti").checkpoint())
        if alive.isEmpty():
            return taken.withColumnRenamed("r_ord", "ord")


def _first_leader(edges: DataFrame) -> DataFrame:
    """Each member with its first leader and the score to it."""
    return (edges.groupBy(F.col("r_ord").alias("ord"))
            .agg(F.min(F.struct("l_ord", "score")).alias("m"))
            .select("ord", F.col("m.l_ord").alias("leader"), F.col("m.score").alias("score")))


def greedy_leaders(nodes: DataFrame, find_edges: EdgeSearch, first_prefix: int = FIRST_PREFIX) -> DataFrame:
    """``(ord, leader, score)`` of every member; leaders and loners are not listed.

    ``nodes`` has a unique, orderable ``ord``.  ``find_edges(left, right, within)``
    returns ``(l_ord, r_ord, score)`` for the similar pairs with ``l_ord < r_ord``;
    ``within`` tells that both sides are the same prefix.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    free = nodes.checkpoint()
    members: list[DataFrame] = []
    size = first_prefix
    while (count := free.count()) > 0:
        if count <= size:
            prefix, rest = free, None
        else:
            cut = free.agg(F.percentile_approx("ord", size / count, 10_000)).first()[0]
            prefix, rest = free.where(F.col("ord") <= F.lit(cut)), free.where(F.col("ord") > F.lit(cut))
        edges = find_edges(prefix, prefix, True).checkpoint()
        leaders = prefix
        if not edges.isEmpty():
            taken = _taken(edges)
            leaders = prefix.join(taken, "ord", "left_anti")
            by_leader = edges.join(taken.withColumnRenamed("ord", "l_ord"), "l_ord", "left_anti")
            members.append(_first_leader(by_leader))
        if rest is None:
            break
        caught = _first_leader(find_edges(leaders, rest, False)).checkpoint()
        members.append(caught)
        free = rest.join(caught, "ord", "left_anti").checkpoint()
        size *= GROWTH
    if not members:
        return nodes.select("ord", F.col("ord").alias("leader"), F.lit(0.0).alias("score")).limit(0)
    out = members[0]
    for more in members[1:]:
        out = out.unionByName(more)
    return out
