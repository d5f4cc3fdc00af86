"""Jaccard join of word n-gram sets: groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from casewell.llm.common import as_given, keep, set_aside, text_batches
from casewell.llm.components import connected_components

GROUPS = 128                # hash groups of a count vector
LEAF = 32                   # points in a leaf of the tree
ONE_LEAF = 64               # members of a shingle that need no tree over them
PAIR_STEP = 1 << 15         # pairs of points looked at in one vectorised step (a count vector each side: 16 MB)
PORTION_ROWS = 10_000       # members of shingles that a task compares at a time, more only where one block has more
BROADCAST_ROWS = 500_000    # documents named by candidates, up to which their ids (16 bytes each) are broadcast
BLOCK_ROWS = 4096           # members of one shingle that a task compares at a time
SAMPLE_SHARE, SAMPLE_LEAST, FREQUENT = 1 / 16, 10_000, 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII letters are lower-cased, a short text is one shingle."""
    words = list(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()))
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.array(words, dtype=np.uint64)
    count, span = (1, len(codes)) if len(codes) < width else (len(codes) - width + 1, width)
    out = np.full(count, np.uint64(span))
    for k in range(span):
        out = ((out ^ (out >> np.uint64(29))) * _MIX[0]) ^ (codes[k:k + count] * _MIX[1])
    out ^= out >> np.uint64(32)
    out *= _MIX[0]
    return np.unique(out ^ (out >> np.uint64(31)))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each hash group."""
    return np.bincount((shingles >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=GROUPS).clip(0, 65_535).astype("<u2")


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection at which sets of these sizes are linked."""
    return -(-(num * (a + b)) // (num + den))


def _overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many common shingles: the coordinate minima summed; a full coordinate counts as no bound."""
    low = np.minimum(a, b)
    return np.where((low == 65_535).any(axis=1), np.int64(1) << 40, low.sum(axis=1, dtype=np.int64))


def tree_pairs(member: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, side: np.ndarray,
               vectors: np.ndarray | None, lists: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list and of different roots that may be linked, found with a packed R-tree, PAIR_STEP looked at
    at a time: what is found is handed on step by step, so that memory does not grow with the pairs of a list.

    Points are packed into leaves by (list, size, count vector sum).  A leaf's box is the maximum of its
    coordinates and its range of sizes; two leaves of a list are opened together only if their sizes fit
    and the summed minima of their upper corners reach the least overlap needed.  Then members are
    bounded the same way, and by their places in the common order of shingles.  ``side`` -1 compares all,
    0 and 1 compare across only.  Without ``vectors`` sizes and places alone decide.
    """
    order = np.lexsort((root, size, lists))
    lists, size, place, root, side = (x[order] for x in (lists, size, place, root, side))
    n = len(order)
    new = np.r_[True, lists[1:] != lists[:-1]]
    inside = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    starts = np.flatnonzero(new | (inside % LEAF == 0))
    ends = np.r_[starts[1:], n]
    if vectors is not None:
        vectors = vectors[order]
        upper = np.maximum.reduceat(vectors, starts, axis=0)
    low, high, own = size[starts], size[ends - 1], lists[starts]
    list_end = np.searchsorted(own, own, side="right")
    lefts, rights = _runs(np.arange(len(starts)), list_end)
    work = np.cumsum((ends - starts)[lefts] * (ends - starts)[rights])
    cuts = [0, *np.searchsorted(work, np.arange(PAIR_STEP, work[-1], PAIR_STEP)).tolist(), len(work)]
    for first, after in zip(cuts, cuts[1:]):
        i, j = lefts[first:after], rights[first:after]
        fit = low[j] * num <= high[i] * den
        i, j = i[fit], j[fit]
        if vectors is not None:
            fit = _overlap_bound(upper[i], upper[j]) >= needed(low[i], low[j], num, den)
            i, j = i[fit], j[fit]
        if not len(i):
            continue
        wide = ends[j] - starts[j]
        rows_i = np.repeat(np.arange(len(i)), ends[i] - starts[i])
        a = starts[i][rows_i] + _count_up(ends[i] - starts[i])
        rows_a = np.repeat(np.arange(len(a)), wide[rows_i])
        a, b = a[rows_a], starts[j][rows_i][rows_a] + _count_up(wide[rows_i])
        ok = (a < b) & (root[a] != root[b]) & ((side[a] < 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        least = needed(size[a], size[b], num, den)
        ok = ((np.minimum(size[a], size[b]) >= least)
              & (np.minimum(size[a] - place[a], size[b] - place[b]) >= least))
        a, b, least = a[ok], b[ok], least[ok]
        if vectors is not None:
            ok = _overlap_bound(vectors[a], vectors[b]) >= least
            a, b = a[ok], b[ok]
        yield member[order[a]], member[order[b]]


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0..s-1 for each size s, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i all pairs (i, j) with first[i] <= j < last[i]."""
    sizes = last - first
    return np.repeat(np.arange(len(first)), sizes), np.repeat(first, sizes) + _count_up(sizes)


def _describe(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Per row: id, set size, set hash, count vector, and the shingles among which every linked set has one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)         # at most FREQUENT hashes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for keys, texts in text_batches(batches):
            sizes, nodes, vectors, heads = [], [], [], []
            for text in texts:
                found = shingle_hashes(text, width)
                n = len(found)
                sizes.append(n)
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if n else None)
                vectors.append(count_vector(found).tobytes() if n else None)
                if len(common) and n:
                    at = np.searchsorted(common, found).clip(0, len(common) - 1)
                    late = common[at] == found
                    found = np.concatenate((found[~late], found[late]))
                heads.append(found[:n - -(-num * n // den) + 1].view(np.int64) if n else None)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "vector", "head"])

    return docs.mapInArrow(work, "doc_id bigint, n_shingles bigint, node bigint, vector binary, head array<bigint>")


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that occur often in a sample of the documents, FREQUENT at most.

    They come last in the common order of shingles, which keeps them out of the search.  Any order gives the same
    links; a good one saves work.
    """
    rows = docs.count()
    if not rows:
        return np.empty(0, dtype=np.uint64)
    part = docs.sample(fraction=min(1.0, max(SAMPLE_SHARE, SAMPLE_LEAST / rows)), seed=11)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            codes, counts = np.unique(np.concatenate([shingle_hashes(t, width) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))],
                                             ["code", "n"])

    top = (part.mapInArrow(work, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where("n >= 3")
           .orderBy(F.desc("n"), "code").limit(FREQUENT).select("code").toPandas()["code"])
    return np.sort(top.to_numpy(dtype=np.int64).view(np.uint64))


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the candidate pairs (``a``, ``b``) whose whole sets are linked.

    The sets are made again from the texts of the documents that some pair names.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = keep(nodes.join(wanted, "node").select("rep", "node"))
    if chosen.count() <= BROADCAST_ROWS:        # else Spark shuffles the texts
        chosen = F.broadcast(chosen)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            codes = [shingle_hashes(t, width).view(np.int64) for t in texts]
            # an id may stand for other texts too
            own = pa.array([xxhash.xxh3_64_intdigest(c.tobytes()) - (1 << 63) == k for c, k in zip(codes, keys.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([keys, pa.array(codes, pa.list_(pa.int64()))], ["node", "codes"]).filter(own)

    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    held = keep(texts.mapInArrow(sets, "node bigint, codes array<bigint>"))
    both = (pairs.join(held.select(F.col("node").alias("a"), F.col("codes").alias("left")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("codes").alias("right")), "b").select("a", "b", "left", "right"))

    # row by row in the JVM: Arrow batches of whole sets would not be bounded in bytes
    common = F.size(F.array_intersect("left", "right")).cast("bigint")
    return both.where((num + den) * common >= num * (F.size("left") + F.size("right"))).select("a", "b")


def _bounded(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose count vectors leave room for enough common shingles."""
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("vector").alias("left")), "a").join(
        held.select(F.col("node").alias("b"), F.col("vector").alias("right")), "b").select("a", "b", "left", "right")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, GROUPS) for c in (2, 3))
            sizes = [v.sum(axis=1, dtype=np.int64) for v in (x, y)]
            good = _overlap_bound(x, y) >= needed(*sizes, num, den)
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.mapInArrow(work, "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Groups of documents linked by ``den * intersection >= num * union`` of their distinct word shingles.

    Result per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Rows with equal sets are one node, told apart by a 64-bit hash.  Linked sets share a shingle among the first few of a
    common order (rare ones first), so those are the keys of the search.  First the members of a key are compared with
    the one that has it earliest, which joins groups of copies in a linear number of pairs.  Then, for keys whose
    members are still in several components, a packed R-tree over hashed count vectors finds all other pairs that could be
    linked; keys with many members are dealt to many tasks in blocks.  Every candidate is checked on its whole sets.

    Null and blank texts have no shingles: size 0, their own id as component.  Rows with equal id and different texts are
    documents of their own.  Null ids never name a component, but a component of such rows only has a null id.
    Other columns are ignored; an empty table gives an empty result; texts of any length count whole.
    """
    rows, of_node = _groups(docs, width, num, den, id_col, text_col)
    return rows.join(of_node.select("node", "component"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _groups(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id``, ``n_shingles``, ``node`` (hash of the set); per node its ``root``, which alone names a component,
    and ``component``, the smallest id in it."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = _describe(docs, width, num, den, _frequent(docs, width))
    rows = keep(described.select("doc_id", "n_shingles", "node"))
    first = keep(described.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "vector", "head")]))
    nodes, held = first.select("node", "rep"), first.select("node", "vector")
    postings = first.select("node", F.col("n_shingles").cast("int").alias("n"), F.posexplode("head").alias("place", "code"))

    # a shingle with one member links nothing; its first member by place is the hub of the others
    of_code = Window.partitionBy("code")
    shared = keep(postings.withColumn("members", F.count("*").over(of_code)).withColumn(
        "hub", F.first(F.struct("place", "node", "n")).over(of_code.orderBy("place", "node"))).where("members > 1"))

    hub, room = F.col("hub"), (lambda n, place: n - place)
    least = F.ceil((F.col("n") + hub["n"]) * num / (num + den))
    stars = shared.where(F.col("node") != hub["node"]).where(
        F.least(room(F.col("n"), F.col("place")), room(hub["n"], hub["place"])) >= least - 1).select(
        F.least("node", hub["node"]).alias("a"), F.greatest("node", hub["node"]).alias("b")).distinct()
    near = keep(_bounded(stars, held, num, den))
    links = _verify(near, docs, nodes, width, num, den)
    roots = keep(connected_components(links, "a", "b").withColumnRenamed("root", "rest"))

    # what is left: keys whose members are in several components
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("rest", "node")).drop("rest", "hub")
    split = placed.groupBy("code").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    open_keys = placed.join(split.select("code"), "code").select(
        "code", "members", "node", "n", "place", "root", own.alias("own"), other.alias("other"))
    names = ["part", "node", "n", "place", "root", "own", "i", "j"]
    open_keys = open_keys.withColumns({
        "i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("part", F.xxhash64("code", "i", "j")).select(
        "members", *[F.col(c).cast("bigint").alias(c) for c in names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # all rows of a part stand together, so a portion ends where a part does
            codes = batch.column(0).to_numpy()
            if waiting and rows + batch.num_rows > PORTION_ROWS:
                cut = len(codes) if codes[0] == codes[-1] == waiting[-1].column(0)[-1].as_py() else int(
                    np.argmax(codes != waiting[-1].column(0)[-1].as_py()))
                if cut < len(codes):
                    yield from pairs_of(waiting + [batch.slice(0, cut)])
                    waiting, rows, batch = [], 0, batch.slice(cut)
            waiting.append(batch)
            rows += batch.num_rows
        if waiting:
            yield from pairs_of(waiting)

    def pairs_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, n, place, root, own, i, j = (np.concatenate([b.column(c).to_numpy() for b in batches])
                                                 for c in range(8))
        vectors = None
        if batches[0].num_columns > 8:
            vectors = np.frombuffer(b"".join(v for b in batches for v in b.column(8).to_pylist()), dtype="<u2").reshape(-1, GROUPS)
        side = np.where(i == j, -1, (own == j).astype(np.int64))
        for a, b in tree_pairs(node, n, place, root, side, vectors, part, num, den):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    few = open_keys.where(F.col("members") <= ONE_LEAF).select(names)
    many = open_keys.where(F.col("members") > ONE_LEAF).join(held, "node").select(*names, "vector")
    found = [part.repartition("part").sortWithinPartitions("part").mapInArrow(search, "a bigint, b bigint") for part in (few, many)]
    rest = keep(_bounded(found[0].union(found[1]).distinct(), held, num, den))
    more = _verify(rest, docs, nodes, width, num, den)
    all_links = roots.select(F.col("node").alias("a"), F.col("rest").alias("b")).union(more)
    final = connected_components(all_links, "a", "b")
    named = nodes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("rep").alias("component"))
    return rows, named.join(names, "root").select("node", "root", "component")


def keep_one(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents with exactly one row of each group left, one with the smallest id; columns as given.

    Groups are told apart by their sets, not by ids: equal ids with texts in different groups leave a row each.  Of several
    rows of a group with its smallest id the first by text stays; null ids come last.  Documents without words are no
    group and stay.  Columns may have any names; an empty table stays empty; texts of any length count whole.
    """
    given, names = set_aside(docs)
    return _one_row_each(given, width, num, den, names[id_col], names[text_col]).select(*as_given(names))


def _one_row_each(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    rows, of_node = _groups(docs, width, num, den, id_col, text_col)
    named = rows.join(of_node, "node", "left")
    mark = keep(named.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("_rows"),
        F.max(F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("component"))).alias("_stays")).where("_stays"))
    own_id = F.col(id_col).cast("bigint")
    single = docs.join(mark.where("_rows = 1"), own_id == F.col("_id")).select(*docs.columns)
    several = mark.where("_rows > 1 or _id is null")
    if several.isEmpty():
        return single

    # an id with several rows says nothing about one of them, so their sets are made again
    @F.pandas_udf("bigint")
    def node_of(texts: pd.Series) -> pd.Series:
        sets = (shingle_hashes(t or "", width) for t in texts)
        return pd.Series([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], dtype="Int64")

    again = docs.join(several.select("_id"), own_id == F.col("_id"), "left_semi").union(docs.where(own_id.isNull())).select(
        F.struct(*docs.columns).alias("_row"), own_id.alias("_id"), F.col(text_col).cast("string").alias("_text"))
    again = again.withColumn("_node", node_of("_text"))
    wordless = again.where("_node is null").select("_row.*")
    first = (again.join(of_node, F.col("_node") == F.col("node")).where(F.col("_id").eqNullSafe(F.col("component")))
             .groupBy("root").agg(F.min_by("_row", F.coalesce("_text", F.lit(""))).alias("_row")).select("_row.*"))
    return single.union(wordless).union(first)
