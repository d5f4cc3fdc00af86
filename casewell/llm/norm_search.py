"""Exact top-k inner products by retrieval from length buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casewell.llm.common import keep

BUCKET_ROWS = 1024              # vectors of like length that share a local cosine threshold
GROUP_BYTES = 16 << 20          # vectors that a task holds at a time, and as many queries
RANGES = 256                    # length ranges of a pass, at most
FOCUS = 4                       # largest coordinates of a query that may prune
COORDINATE_FROM = 0.5           # local cosine threshold from which coordinates are tried
SAMPLE_STEP, SAMPLE_LEAST = 16, 2048
_LEAST = np.iinfo(np.int64).min
_SLACK = 1e-9                   # room for rounding in every bound


def integer_vectors(column: pa.ChunkedArray | pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as ``floor(scale * x)`` one after the other, where each vector begins, and which vectors take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    good = np.array(column.is_valid().to_pylist(), dtype=bool)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
        fits = np.abs(x) < 2.0 ** 62            # false for nulls, which are NaN here
    good[np.repeat(np.arange(len(sizes)), sizes)[~fits]] = False
    return np.where(fits, x, 0.0).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), good


def coordinate_range(query: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of a unit vector can lie if its cosine with a unit vector that has ``query`` there is ``cosine`` or more."""
    own, away = np.arccos(np.clip(query, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, own + away)) - _SLACK, np.cos(np.maximum(0, own - away)) + _SLACK


class Bucket:
    """Vectors of like length, longest first, with sorted lists of their unit coordinates."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray):
        self.vectors, self.norms = vectors, norms
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in order of unit coordinate ``f``, and that coordinate."""
        if f not in self._lists:
            unit = self.vectors[:, f].astype(np.float64) / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self._lists[f] = order, unit[order]
        return self._lists[f]

    def by_coordinate(self, query: np.ndarray, norm: float, local: float) -> np.ndarray | None:
        """Vectors in the feasible range of the query's best focus coordinate; None if it keeps more than half of them."""
        focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
        low, high = coordinate_range(query[focus].astype(np.float64) / norm, np.full(len(focus), local))
        best = None
        for f, least, most in zip(focus.tolist(), low, high):
            order, values = self.coordinate(f)
            first, after = np.searchsorted(values, least), np.searchsorted(values, most, side="right")
            if best is None or after - first < len(best):
                best = order[first:after]
        return best if best is not None and 2 * len(best) <= len(self.norms) else None


def _products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, held at their ends where they do not fit."""
    if not vectors.size or not queries.size:
        return np.zeros((len(vectors), len(queries)), dtype=np.int64)
    most = float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).max()) * vectors.shape[1]
    if most < 2.0 ** 53:
        return (vectors.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    exact = vectors.astype(object) @ queries.T.astype(object)
    return np.array([[min(max(v, _LEAST + 1), -_LEAST - 1) for v in row] for row in exact], dtype=np.int64).reshape(exact.shape)


def _best(owner: np.ndarray, score: np.ndarray, tie: np.ndarray, limit: int) -> np.ndarray:
    """Places of each owner's ``limit`` highest scores, smaller ``tie`` first among equals."""
    order = np.lexsort((tie, -score.astype(np.float64), owner))
    if (np.abs(score) >= 1 << 53).any():
        order = np.array(sorted(range(len(owner)), key=lambda i: (owner[i], -int(score[i]), tie[i])), dtype=np.int64)
    new = np.r_[True, owner[order][1:] != owner[order][:-1]] if len(order) else np.zeros(0, dtype=bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < limit]


def best_products(vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray, tie: np.ndarray, queries: np.ndarray,
                  query_norms: np.ndarray, query_rows: np.ndarray, least: np.ndarray, limit: int,
                  bucket_rows: int = BUCKET_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of each query's best vectors of a group, among scores of ``least`` or more.

    Vectors come longest first.  A bucket's local cosine threshold for a query is its score threshold over both
    lengths: beyond 1 the bucket is passed over; a high one is tried on the sorted lists of the query's largest
    coordinates; else the bucket's vectors of sufficient length are taken.  What is left is verified by its product, and
    the thresholds rise from bucket to bucket.
    """
    least = least.copy()
    owner, member, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for at in range(0, len(vectors), bucket_rows):
        bucket = Bucket(vectors[at:at + bucket_rows], norms[at:at + bucket_rows])
        wanted = least.astype(np.float64)
        reach = query_norms * bucket.norms[0]
        alive = np.flatnonzero(wanted <= reach * (1 + _SLACK) + _SLACK)
        local = np.where(reach > 0, wanted / np.maximum(reach, 1e-300), 0.0)
        found, whole = [], []
        for k in alive.tolist():
            picked = bucket.by_coordinate(queries[k], query_norms[k], local[k] * (1 - _SLACK)) if local[k] >= COORDINATE_FROM else None
            if picked is None:
                whole.append(k)
            else:
                found.append((np.full(len(picked), k), picked, _products(bucket.vectors[picked], queries[k:k + 1])[:, 0]))
        if whole:
            # lengths fall, so what can reach a threshold is a first part of the bucket
            shortest = (wanted[whole] - _SLACK) / np.maximum(query_norms[whole] * (1 + _SLACK), 1e-300)
            parts = np.searchsorted(-bucket.norms, -shortest, side="right")
            part = int(parts.max())
            products = _products(bucket.vectors[:part], queries[whole])
            i, j = np.nonzero(products >= least[whole][None, :])
            found.append((np.array(whole)[j], i, products[i, j]))
        if not found:
            continue
        k, i, s = (np.concatenate(x) for x in zip(*found))
        ok = (s >= least[k]) & (rows[at + i] != query_rows[k])
        owner, member, score = (np.concatenate(x) for x in ((owner, k[ok]), (member, at + i[ok]), (score, s[ok])))
        best = _best(owner, score, tie[member], limit)
        owner, member, score = owner[best], member[best], score[best]
        full = np.flatnonzero(np.bincount(owner, minlength=len(least)) >= limit)
        last = np.searchsorted(owner, full, side="right") - 1
        least[full] = np.maximum(least[full], score[last])
    return owner, member, score


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(cells), width // 8), dtype=np.int64)
    for k, cell in enumerate(cells):
        out[k, :len(cell) // 8] = np.frombuffer(cell, dtype="<i8")
    return out


def _pass(queries: DataFrame, vectors: DataFrame, limit: int, width: int) -> DataFrame:
    """Each query's best vectors per group: ``q_row``, ``query_id``, ``vec_id``, ``score``."""
    most = max(64, GROUP_BYTES // max(width, 8))
    number = vectors.count()
    cuts = vectors.agg(F.percentile_approx("norm", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    step = -(-RANGES // max(1, -(-number // most)))
    cuts = sorted(set(cuts[step - 1::step]))
    in_range = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("norm"))) if cuts else F.lit(0)
    ranged = vectors.withColumn("range", in_range)
    ranges = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    blocks = max(1, -(-queries.count() // most))
    if not ranges:
        ranges = {0: {"n": 1, "top": 0.0}}
    salts = F.array(*[F.lit(-(-ranges[r]["n"] // most) if r in ranges else 1) for r in range(len(cuts) + 1)])
    left = ranged.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.element_at(salts, F.col("range") + 1)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    # a query goes to the groups whose longest vector can reach its threshold
    right = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)).cast("int"))
    ranges_of = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(float(x["top"])).alias("top"))
                          for r, x in sorted(ranges.items())])
    fits = F.filter(ranges_of, lambda g: F.col("least") <= F.col("norm") * g["top"] * (1 + _SLACK) + _SLACK)
    right = right.withColumn("at", F.explode(fits)).withColumn("range", F.col("at.range"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("range") + 1) - 1))).drop("at")

    result = pa.schema([(c, pa.int64()) for c in ("q_row", "query_id", "vec_id", "score")])

    def compare(both: pa.Table) -> pa.Table:
        asks = both.column("least").is_valid()
        own, asked = both.filter(pa.compute.invert(asks)), both.filter(asks)
        if not own.num_rows or not asked.num_rows:
            return result.empty_table()
        cell = {c: own.column(c).to_numpy() for c in ("row", "norm")}
        order = np.argsort(-cell["norm"], kind="stable")
        cells = own.column("cell").to_pylist()
        ids = own.column("vec_id").to_pylist()
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        tie = np.empty(len(ids), dtype=np.int64)
        tie[rank] = np.arange(len(ids))
        k, i, s = best_products(
            _matrix([cells[x] for x in order], width), cell["norm"][order], cell["row"][order], tie[order],
            _matrix(asked.column("cell").to_pylist(), width), asked.column("norm").to_numpy(), asked.column("row").to_numpy(),
            asked.column("least").to_numpy(), limit)
        return pa.table({"q_row": asked.column("row").to_numpy()[k], "query_id": asked.column("vec_id").to_numpy()[k],
                         "vec_id": pa.array([ids[x] for x in order[i].tolist()], pa.int64()), "score": s})

    names = ["range", "salt", "block", "row", "vec_id", "norm", "cell", "least"]
    met = left.withColumn("least", F.lit(None).cast("bigint")).select(names).union(right.select(names))
    return met.groupBy("range", "salt", "block").applyInArrow(compare, "q_row bigint, query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_products(table: DataFrame, is_query: Column, limit: int = 20, scale: float = 64.0, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """The ``limit`` highest inner products of every query with all other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components count as ``floor(scale * x)`` in integers.  ``is_query`` marks the queries; a query meets every row but its
    own.  Rows are dealt to groups by length (a length that many share to several), queries to blocks, and a block
    meets only the groups whose length can reach its thresholds.  Inside, buckets of like length are searched as
    ``best_products`` says.  The thresholds come from passes over samples of 1/16, 1/256 ... of the rows, so every pass, the last
    of which covers all rows, hands on few results per query.  All is exact; sampling only decides what can be skipped.

    Vectors that are null, hold null or non-finite components, or components that do not fit 62 bits, take no part.
    Empty vectors and zeros score 0; vectors of unequal length are compared as if padded with zeros; scores beyond 64
    bits are held at the ends of the range.  Equal scores go by smaller id, null ids last; repeated rows are rows
    of their own, and a repeated query id has a ranking for each of its rows.  Other columns are ignored; without rows or
    queries the result is empty.
    """
    source = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"),
                          F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).cast("array<double>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, starts, good = integer_vectors(batch.column(3), scale)
            norms = np.array([float(np.linalg.norm(whole[a:b].astype(np.float64))) for a, b in zip(starts, starts[1:])])
            cells = [whole[a:b].astype("<i8").tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(norms, pa.float64()),
                                              pa.array(cells, pa.binary())], ["row", "vec_id", "asked", "norm", "cell"]).filter(pa.array(good))

    rows = keep(source.mapInArrow(prepare, "row bigint, vec_id bigint, asked boolean, norm double, cell binary"))
    number, width = rows.agg(F.count("*"), F.max(F.octet_length("cell"))).first()
    vectors = rows.select("row", "vec_id", "norm", "cell")
    queries = rows.where("asked").select("row", "vec_id", "norm", "cell", F.lit(int(_LEAST)).alias("least"))
    steps = 0
    while number // SAMPLE_STEP ** (steps + 1) >= SAMPLE_LEAST:
        steps += 1
    for step in range(steps, 0, -1):
        part = vectors.where(F.pmod(F.xxhash64("row", F.lit(11)), F.lit(SAMPLE_STEP ** step)) == 0)
        last = _ranked(_pass(queries, part, limit, width), limit).where(F.col("rank") == limit)
        known = last.select(F.col("q_row").alias("row"), F.col("score").alias("known"))
        queries = keep(queries.join(known, "row", "left").withColumn("least", F.greatest("least", F.coalesce("known", "least"))).drop("known"))
    found = _ranked(_pass(queries, vectors, limit, width or 8), limit)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
