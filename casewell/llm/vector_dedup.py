"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import keep
from casewell.llm.components import connected_components

TREES = 6                       # at least; more with more levels, see trees_for
SHARED = 0.93                   # least chance that a linked pair stays together at a split
MISSED = 0.015                  # aim for the share of linked pairs that no tree keeps together
MOST_LEVELS = 36
SPILL = 0.08                    # half width of the overlap at a split, in deviations of the projections (1 / sqrt(dimensions))
LEAF_ROWS = 512                 # expected rows of a leaf
BLOCK_ROWS = 1024               # rows of a leaf that a task compares at a time
SAMPLE_ROWS = 100_000           # vectors that the split values are fitted on


def levels_for(rows: int, leaf_rows: int) -> int:
    """Levels at which leaves hold about ``leaf_rows`` of so many rows."""
    return max(0, min(MOST_LEVELS, math.ceil(math.log2(max(1, rows) / leaf_rows))))


def trees_for(levels: int) -> int:
    """Trees that make up for the pairs that so many splits part."""
    return max(TREES, math.ceil(math.log(MISSED) / math.log1p(-SHARED ** levels))) if levels else TREES


def fit_forest(sample: np.ndarray, rows: int, trees: int | None, leaf_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions [tree, level, dim], split values [tree, node] of the upper levels and [tree, level] of those below.

    All nodes of a level share a direction, and the number of levels follows the number of rows.  A node splits at the median
    of the sample's vectors in it while some eight are left there; below, where the sample says nothing of single nodes, all nodes
    of a level split at the median of the whole sample, so the forest stays small however many rows there are.
    """
    levels = levels_for(rows, leaf_rows)
    upper = min(levels, max(0, int(math.log2(max(1, len(sample)) / 8))))
    trees = trees or trees_for(levels)
    random = np.random.default_rng(seed)
    directions = random.standard_normal((trees, levels, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits, below = np.zeros((trees, 1 << upper)), np.zeros((trees, levels))
    for t in range(trees):
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(levels):
            seen = sample @ directions[t, level]
            if level >= upper:
                below[t, level] = np.median(seen) if len(seen) else 0.0
                continue
            order = np.lexsort((seen, node))
            names, first, size = np.unique(node[order], return_index=True, return_counts=True)
            splits[t, names] = seen[order[first + size // 2]]
            node = 2 * node + (seen > splits[t, node])
    return directions, splits, below


def leaves_of(vectors: np.ndarray, directions: np.ndarray, splits: np.ndarray, below: np.ndarray, spill: float) -> list[np.ndarray]:
    """For each tree an array [2, n]: row of the vector and the leaf; a vector near a split goes to both sides."""
    out = []
    upper = splits.shape[1].bit_length() - 1
    for t in range(directions.shape[0]):
        rows, node = np.arange(len(vectors)), np.ones(len(vectors), dtype=np.int64)
        for level in range(directions.shape[1]):
            away = (vectors @ directions[t, level])[rows] - (splits[t, node] if level < upper else below[t, level])
            both = np.abs(away) <= spill
            node = np.concatenate((2 * node + (away > 0), 2 * node[both] + (away[both] <= 0)))
            rows = np.concatenate((rows, rows[both]))
        out.append(np.stack((rows, node)))
    return out


def count_links(vectors: np.ndarray, leaves: list[frozenset], weight: np.ndarray, order: np.ndarray, own: int, left: np.ndarray,
                right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two groups of rows of leaf ``own``, each pair counted in its first common leaf only.

    Returns per row the number of linked vectors and the smallest ``order`` it reaches by links between the two groups.
    """
    counts, lowest, linked = np.zeros(len(vectors), dtype=np.int64), order.copy(), []
    same = left is right
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        i, j = np.nonzero(vectors[rows] @ vectors[right].T >= least)
        i, j = rows[i], right[j]
        keep_pair = i < j if same else i != j
        i, j = i[keep_pair], j[keep_pair]
        if not len(i):
            continue
        linked.append((i, j))
        first = np.fromiter((min(leaves[a] & leaves[b]) == own for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
        i, j = i[first], j[first]
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
    if linked:
        i, j = (np.concatenate(x) for x in zip(*linked))
        while True:
            before = lowest.copy()
            np.minimum.at(lowest, i, before[j])
            np.minimum.at(lowest, j, before[i])
            if (before == lowest).all():
                break
    return counts, lowest


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one (not null, not zero, all components finite)."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r), default=0)
    out, good = np.zeros((len(rows), width)), np.zeros(len(rows), dtype=bool)
    for k, r in enumerate(rows):
        if r and None not in r:
            out[k, :len(r)] = r
            top = np.abs(out[k]).max()
            if np.isfinite(top) and top > 0:
                out[k] /= top
                out[k] /= np.linalg.norm(out[k])
                good[k] = True
    return out, good


def near_duplicates(table: DataFrame, least: float = 0.95, trees: int | None = None, spill: float | None = None, leaf_rows: int = LEAF_ROWS,
                    id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """Groups of vectors linked by a cosine of ``least`` or more: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are compared once and weighted.  Each tree splits at random projections, vectors near a split go to both
    sides, and vectors are compared in double precision within leaves; leaves with many vectors are dealt to
    several tasks in blocks.  A vector carries the list of its leaves, so a pair that meets in several is counted in the
    first alone, and no pair ever leaves a task: a block returns per vector a count and the lowest vector it reaches, which
    joins a block's links into stars.

    The split values are fitted on at most SAMPLE_ROWS vectors; every vector is indexed.  The levels follow the rows and the trees the
    levels, unless ``trees`` are given; ``spill`` is the half width of the overlap, by default SPILL deviations.  Null, zero and non-finite vectors
    have no links and are their own component; vectors of unequal length are compared as if padded with zeros; equal
    ids are one vector if their values agree and separate ones otherwise (their components then share the id); null ids
    are kept and never name a component.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    source = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = unit_vectors(batch.column(1))
            nodes = [xxhash.xxh3_64_intdigest(u.tobytes().rstrip(b"\0")) - (1 << 63) if g else None for u, g in zip(units, good)]
            cells = [u.astype("<f8").tobytes() if g else None for u, g in zip(units, good)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(cells, pa.binary())],
                                             ["vec_id", "node", "unit"])

    rows = keep(source.mapInArrow(prepare, "vec_id bigint, node bigint, unit binary"))
    distinct = keep(rows.where("node is not null").groupBy("node").agg(
        F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("rep")))
    number = distinct.count()
    part = distinct.select("unit").sample(fraction=min(1.0, 1.2 * SAMPLE_ROWS / max(1, number)), seed=seed).limit(SAMPLE_ROWS)
    taken = [np.frombuffer(r[0], dtype="<f8") for r in part.toLocalIterator()]
    width = distinct.agg(F.max(F.octet_length("unit"))).first()[0] or 8
    sample = np.zeros((len(taken), width // 8))
    for k, v in enumerate(taken):
        sample[k, :len(v)] = v
    overlap = SPILL / math.sqrt(max(1, width // 8)) if spill is None else spill
    forest = spark.sparkContext.broadcast(fit_forest(sample, number, trees, leaf_rows, seed))      # bounded by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, splits, below = forest.value
        for batch in batches:
            units = np.zeros((batch.num_rows, width // 8))
            for k, cell in enumerate(batch.column(1).to_pylist()):
                units[k, :len(cell) // 8] = np.frombuffer(cell, dtype="<f8")
            mine: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for t, (at, leaf) in enumerate(leaves_of(units, directions, splits, below, overlap)):
                for k, x in zip(at.tolist(), (leaf + (t << 40)).tolist()):
                    mine[k].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(m)) for m in mine], pa.list_(pa.int64()))],
                                             ["node", "leaves"])

    indexed = distinct.select("node", "unit").mapInArrow(index, "node bigint, leaves array<bigint>")
    placed = keep(distinct.join(indexed, "node").select("node", "unit", "weight", "leaves"))
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    members = placed.select("*", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).select(
        "*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         F.col("own").cast("int").alias("own"), "node", "unit", "weight", "leaves").withColumn(
        "part", F.xxhash64("leaf", "i", "j"))

    def compare(frame: pa.Table) -> pa.Table:
        cell = {c: frame.column(c).combine_chunks() for c in ("node", "weight", "own", "i", "j", "leaf")}
        node, weight, own = (cell[c].to_numpy() for c in ("node", "weight", "own"))
        units = np.zeros((len(node), width // 8))
        for k, x in enumerate(frame.column("unit").to_pylist()):
            units[k, :len(x) // 8] = np.frombuffer(x, dtype="<f8")
        leaves = [frozenset(x) for x in frame.column("leaves").to_pylist()]
        i, j, leaf = (cell[c][0].as_py() for c in ("i", "j", "leaf"))
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        counts, lowest = count_links(units, leaves, weight, node, leaf, left, right, least)
        some = np.flatnonzero(counts > 0)
        return pa.table({"node": node[some], "links": counts[some], "lowest": lowest[some]})

    met = keep(dealt.groupBy("part").applyInArrow(compare, "node bigint, links bigint, lowest bigint"))
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met, "node", "lowest")
    named = distinct.select("node", "rep", "weight").join(linked, "node", "left").join(roots, "node", "left").select(
        "node", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = named.join(names, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
