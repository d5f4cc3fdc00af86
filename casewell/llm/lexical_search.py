"""Ranked lexical search: posting lists in geometric blocks with exact summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casewell.llm.common import keep

SHARD_POSTINGS = 1_000_000      # postings whose lists a task holds at a time
BLOCK_DOCS = 64                 # documents of a posting list under one summary
BATCH_POSTINGS = 8192           # postings of short lists that are opened together
ROUND_PAIRS = 20_000            # documents weighed for items at a time
SUMMARY_CELLS = 4_000_000       # cells of the summaries that are made at a time
SKETCH = 12                     # dimensions in which documents are compared for blocking
ITEM_BYTES = 16 << 20           # terms of the items that are searched together; further items take another pass
PORTION = 1 << 20               # bytes of a text cut into terms at a time
SAMPLE_STEP, SAMPLE_LEAST = 16, 8192
_BLANK = ord(" ")
#: Term bytes as they are (A-Z in lower case), all other ASCII as blanks.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else _BLANK for c in range(256)).lower()


def count_terms(text: bytes | None) -> Counter:
    """How often each term occurs in a whole UTF-8 text; null has none."""
    found: Counter = Counter()
    data = (text or b"").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PORTION)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_terms(sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``m`` of documents with so many terms."""
    if len(sizes) and int(sizes.max()) * 50 * documents >= 1 << 63:
        return np.array([50 + 50 * int(n) * documents // total for n in sizes], dtype=np.int64)
    return 50 + (50 * documents * sizes) // max(total, 1)


class Shard:
    """Some documents with the scores their terms bring, and their posting lists."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, gains: np.ndarray, order: np.ndarray):
        """``order`` ranks terms, the first opened first; ``starts`` says where each document's terms begin."""
        self.ids, self.starts, self.terms, self.gains = ids, starts, terms, gains
        self.owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        by_term = np.lexsort((self.owner, order[terms]))
        self.list_docs = self.owner[by_term]
        self.lists, self.list_starts = np.unique(terms[by_term], return_index=True)
        rank = np.argsort(self.list_starts)
        self.lists, self.list_starts = self.lists[rank], np.append(self.list_starts[rank], len(terms))
        self.list_tops = np.maximum.reduceat(gains[by_term], self.list_starts[:-1]) if len(terms) else np.zeros(0, dtype=np.int64)
        self._sketch: np.ndarray | None = None

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of the documents, and where each document's begin."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        return np.repeat(self.starts[docs] - begins[:-1], sizes) + np.arange(begins[-1]), begins

    def sketches(self) -> np.ndarray:
        """Random projections of the documents' vectors, which keep like documents together."""
        if self._sketch is None:
            directions = np.random.default_rng(29).standard_normal((int(self.terms.max(initial=0)) + 1, SKETCH)).astype(np.float32)
            self._sketch = np.zeros((len(self.ids), SKETCH), dtype=np.float32)
            for d in range(SKETCH):
                self._sketch[:, d] = np.bincount(self.owner, self.gains * directions[self.terms, d], len(self.ids)) / 1e9
        return self._sketch

    def blocks(self, docs: np.ndarray) -> list[np.ndarray]:
        """A posting list's documents in clusters of at most BLOCK_DOCS: each goes to the nearest of evenly chosen ones."""
        if len(docs) <= BLOCK_DOCS:
            return [docs]
        own = self.sketches()[docs]
        chosen = own[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK_DOCS)).astype(np.int64)]
        lengths = (chosen * chosen).sum(axis=1) / 2
        near = np.concatenate([np.argmax(own[a:a + 4096] @ chosen.T - lengths, axis=1) for a in range(0, len(docs), 4096)])
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        return [docs[part[a:a + BLOCK_DOCS]] for part in np.split(order, cuts) for a in range(0, len(part), BLOCK_DOCS)]

    def summary(self, blocks: list[np.ndarray], width: int) -> np.ndarray:
        """Per block the largest gain of each term in it."""
        places, begins = self.entries(np.concatenate(blocks))
        block = np.repeat(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), np.diff(begins))
        out = np.zeros(len(blocks) * width, dtype=np.int64)
        np.maximum.at(out, block * width + self.terms[places], self.gains[places])
        return out.reshape(len(blocks), width)

    def scores(self, docs: np.ndarray, item: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of documents for items; ``wanted`` marks the terms of every item."""
        places, begins = self.entries(docs)
        gain = np.where(wanted[np.repeat(item, np.diff(begins)), self.terms[places]], self.gains[places], 0)
        sums = np.concatenate(([0], np.cumsum(gain)))
        return sums[begins[1:]] - sums[begins[:-1]]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range of ``count`` numbers from ``first`` on: whose they are, and the numbers."""
    ends = np.cumsum(count)
    whose = np.repeat(np.arange(len(count)), count)
    return whose, first[whose] + np.arange(ends[-1] if len(ends) else 0) - (ends - count)[whose]


def search_shard(shard: Shard, items: list[np.ndarray], width: int, least: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, places and scores of each item's best documents in a shard; exact for scores of ``least`` or more.

    Lists are opened from the weightiest term on, short ones several at a time.  A document that no earlier list of the
    item holds can score the largest gains of the later ones at most, so an item is done once their sum is too small.
    An opened list is cut into blocks; a block is passed over only if the sum of its summary over the item's
    terms from this list on falls short.
    """
    least = np.maximum(least, 1)
    place = np.full(width, -1, dtype=np.int64)
    place[shard.lists] = np.arange(len(shard.lists))
    term = np.concatenate([np.zeros(0, dtype=np.int64), *items])
    owner = np.repeat(np.arange(len(items)), [len(t) for t in items])
    wanted = np.zeros((len(items), width), dtype=bool)
    wanted[owner, term] = True
    held = place[term] >= 0
    term, owner = term[held], owner[held]
    order = np.lexsort((place[term], owner))
    term, owner = term[order], owner[order]
    after = np.searchsorted(owner, owner, side="right")                     # where an item's terms end
    sums = np.concatenate(([0], np.cumsum(shard.list_tops[place[term]])))
    rest = sums[after] - sums[:-1]                                          # most that the lists from here on can bring
    by_list = np.argsort(place[term], kind="stable")
    listed = place[term][by_list]
    sizes = np.diff(shard.list_starts)
    done = np.zeros((len(items), len(shard.ids)), dtype=bool)
    best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    most_blocks = max(1, SUMMARY_CELLS // width)
    at = 0
    while at < len(shard.lists):
        end = max(at + 1, int(np.searchsorted(shard.list_starts, shard.list_starts[at] + BATCH_POSTINGS, side="right")) - 1)
        end = min(end, at + most_blocks)
        asks = by_list[np.searchsorted(listed, at):np.searchsorted(listed, end)]
        asks = asks[rest[asks] >= least[owner[asks]]]
        opened, at = np.unique(place[term[asks]]), end
        if not len(asks):
            continue
        cut = [shard.blocks(shard.list_docs[shard.list_starts[x]:shard.list_starts[x + 1]]) for x in opened]
        blocks = [b for part in cut for b in part]
        begins = np.concatenate(([0], np.cumsum([len(part) for part in cut])))
        own = np.searchsorted(opened, place[term[asks]])
        whose, block = _spread(begins[own], np.diff(begins)[own])
        ask, bound = asks[whose], np.zeros(len(block), dtype=np.int64)
        for first in range(0, len(blocks), most_blocks):
            here = np.flatnonzero((block >= first) & (block < first + most_blocks))
            summary = shard.summary(blocks[first:first + most_blocks], width)
            for some in np.array_split(here, 1 + len(here) // 50_000):
                pair, later = _spread(ask[some], after[ask[some]] - ask[some])
                np.add.at(bound, some[pair], summary[block[some][pair] - first, term[later]])
        item = owner[ask]
        chosen = np.flatnonzero(bound >= least[item])
        chosen = chosen[np.argsort(-bound[chosen], kind="stable")]
        length = np.array([len(b) for b in blocks])
        flat, starts = np.concatenate(blocks), np.concatenate(([0], np.cumsum(length)))
        while len(chosen):
            take = max(1, int(np.searchsorted(np.cumsum(length[block[chosen]]), ROUND_PAIRS)))
            part, chosen = chosen[:take], chosen[take:]
            pair, where = _spread(starts[block[part]], length[block[part]])
            keys = np.unique(item[part][pair] * len(shard.ids) + flat[where])
            q, docs = keys // len(shard.ids), keys % len(shard.ids)
            fresh = ~done[q, docs]
            q, docs = q[fresh], docs[fresh]
            done[q, docs] = True
            score = shard.scores(docs, q, wanted)
            good = score >= least[q]
            best = tuple(np.concatenate(x) for x in zip(best, (q[good], docs[good], score[good])))
            best = _top(*best, limit)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(items)) >= limit)
            least[full] = np.maximum(least[full], best[2][np.searchsorted(best[0], full, side="right") - 1])
            chosen = chosen[bound[chosen] >= least[item[chosen]]]
        # weighed, or in a block that falls short for good
        pair, where = _spread(shard.list_starts[place[term[asks]]], sizes[place[term[asks]]])
        done[owner[asks][pair], shard.list_docs[where]] = True
    return best


def _top(item: np.ndarray, docs: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's ``limit`` highest scores, highest first; documents stand in order of their ids, smaller ones first among equals."""
    order = np.lexsort((docs, -score, item))
    item, docs, score = item[order], docs[order], score[order]
    first = np.searchsorted(item, item)
    kept = np.arange(len(item)) - first < limit
    return item[kept], docs[kept], score[kept]


def _forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with terms: ``doc_id``, ``n``, and the items' terms in it with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)        # ITEM_BYTES of terms at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, terms, counts = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    found = count_terms(text.as_py())
                    if found:
                        mine = [(codes[t], n) for t, n in found.items() if t in codes]
                        ids.append(key)
                        sizes.append(found.total())
                        terms.append([t for t, _ in mine])
                        counts.append([n for _, n in mine])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                                  pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(work, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def _search(forward: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, least: np.ndarray,
            limit: int) -> DataFrame:
    """Each shard's best documents of each item: ``item`` (its place in the list), ``doc_id``, ``score``."""
    order = np.argsort(np.argsort(-weights, kind="stable"), kind="stable")
    shared = forward.sparkSession.sparkContext.broadcast((items, weights, order, least))

    def answer(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        asked, weight, rank, lowest = shared.value
        rows = pa.Table.from_batches(waiting).combine_chunks()
        ids = rows.column(0)
        by_id = pa.compute.sort_indices(rows.select(["doc_id"]), sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        rows, ids = rows.take(by_id), ids.take(by_id)
        terms, counts = rows.column("terms").combine_chunks(), rows.column("counts").combine_chunks()
        starts = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)))).astype(np.int64)
        codes, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, counts))
        m = np.repeat(length_terms(rows.column("n").to_numpy(), documents, total), np.diff(starts))
        gains = weight[codes] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        shard = Shard(np.arange(rows.num_rows), starts, codes, gains, rank)
        item, place, score = search_shard(shard, asked, len(weight), lowest, limit)
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.take(pa.array(place)).combine_chunks(), pa.array(score)],
                                          ["item", "doc_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, postings = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                waiting.append(part)
                postings += len(part.column(2).flatten()) + part.num_rows
                if postings >= SHARD_POSTINGS:
                    yield answer(waiting)
                    waiting, postings = [], 0
        if waiting:
            yield answer(waiting)

    return forward.mapInArrow(work, "item int, doc_id bigint, score bigint")


def _best(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _rank_some(docs: DataFrame, names: list, items: list[list[bytes]], limit: int, id_col: str, text_col: str) -> DataFrame:
    """The ranking for items whose terms one task can hold; ``item`` is the place in the list."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for terms in items for t in terms}))}
    forward = keep(_forward(docs, vocabulary, id_col, text_col))
    documents, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in holding.toLocalIterator():          # a row per term of the items at most
        weights[term] = term_weight(documents, df)
    asked = [np.array(sorted(vocabulary[t] for t in set(terms)), dtype=np.int64) for terms in items]
    least = np.zeros(len(items), dtype=np.int64)
    steps = 0
    while documents // SAMPLE_STEP ** (steps + 1) >= SAMPLE_LEAST:
        steps += 1
    for step in range(steps, 0, -1):
        part = forward.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SAMPLE_STEP ** step)) == 0)
        last = _best(_search(part, asked, weights, documents, total, least, limit), limit).where(F.col("rank") == limit)
        least = least.copy()
        for item, score in last.select("item", "score").collect():          # a row per item
            least[item] = score
    found = _best(_search(forward, asked, weights, documents, total, least, limit), limit)
    ids = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(names), dtype=np.int32), "item_id": pd.array(names, dtype="Int64")}),
                                "item int, item_id bigint")
    return found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, limit: int = 50, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``limit`` documents of highest score above 0 for every item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Each text is cut into terms once; documents keep the counts of the items' terms.  Tasks hold shards of documents with
    a posting list per term.  A list's documents are clustered by likeness, and every block has the largest gain of each
    term as its summary.  Scores are integers, and blocks are passed over only where their exact bound falls short of
    a score that ``limit`` documents are known to reach: found in the shard so far, or in passes over samples of 1/16, 1/256 ...
    of all documents.  A shard hands on ``limit`` rows per item at most.  Items are searched together up to ``item_bytes``
    of terms; more of them take further passes.

    Null and empty texts have no terms and are not counted as documents; repeated rows and equal ids are documents of their own;
    equal scores go by smaller id, null ids last.  Items of the same id (null too) are one item with the terms of all;
    items without terms have no rows.  Texts of any length count whole; other columns are ignored; empty tables give an
    empty result.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = list(count_terms(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    texts = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    terms = keep(texts.mapInArrow(cut, "item_id bigint, term binary").distinct())
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    passes = -(-size // item_bytes)
    parts = []
    for k in range(passes):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toLocalIterator()
        of_item: dict = {}
        for key, term in rows:
            of_item.setdefault(key, []).append(bytes(term))
        if of_item:
            parts.append(_rank_some(docs, list(of_item), list(of_item.values()), limit, id_col, text_col))
    if not parts:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
