"""Token ids as files: blocks of ids split into byte planes, each compressed, with a chunk index."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from casewell.llm.common import PieceMemory, keep, odd_gaps, space_pieces

MAGIC = b"TPL1"
BLOCK_IDS = 65_536
SPACE = "\u0120"                # the visible stand-in of a space in byte-level vocabularies
START_BYTES = 32 << 20          # of first pieces and endings that a worker remembers
PORTION = 2048                  # texts encoded together; each distinct piece of them is looked up once
#: Letters at the start of a piece that an ASCII sign, digit or gap follows: a pre-token always ends there.
_WORD = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?=[\x00-@\\[-`{-\x7f])")


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Tokenizer:
    return Tokenizer.from_str(spec)


class PieceEncoder:
    """A byte-level tokenizer of the tokenizers library behind bounded memories of pieces.

    Holds for tokenizers without normalizer whose pre-tokenizer keeps a space with the word after it.  Texts with an
    added token's string go to the library whole, as such a string is cut out before anything else.  A piece that opens
    with a word is remembered in two parts, the word and what follows it, as few words come with few endings.
    """

    def __init__(self, spec: str):
        layout = json.loads(spec)
        before = layout.get("pre_tokenizer") or {}
        plain = (layout.get("normalizer") is None and before.get("type") == "ByteLevel"
                 and not before.get("add_prefix_space") and before.get("use_regex", True))
        self.library = _tokenizer(spec)
        # a word of ASCII letters is one pre-token, written as it is after the stand-in of its space
        self.of_words = _tokenizer(json.dumps(layout | {"pre_tokenizer": {"type": "WhitespaceSplit"}})) if plain else None
        self.added = [t["content"] for t in layout.get("added_tokens", [])]
        self.by_piece = plain
        self.memory, self.starts = PieceMemory(), PieceMemory(START_BYTES)      # after a space, and without one
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            self.opens[k] = token.startswith(SPACE)

    @staticmethod
    def _ids(library: Tokenizer, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, store: dict[str, bytes], pieces: list[str]) -> None:
        """Encodes new pieces, many in one text, cut again where a token opens with a space."""
        words, others, odd = [], [], []
        for p in pieces:
            (words if p.isascii() and p.isalpha() else others if p and " " not in p else odd).append(p)
        for library, gap, group in ((self.of_words, " " + SPACE, words), (self.library, " ", others)):
            groups = [group[at:at + 256] for at in range(0, len(group), 256)]
            for part, packed in zip(groups, self._ids(library, [gap + gap.join(g) for g in groups])):
                ends = (np.flatnonzero(self.opens[np.frombuffer(packed, dtype="<u4")]) * 4).tolist() + [len(packed)]
                if len(ends) != len(part) + 1:
                    odd += part
                for piece, a, b in zip(part, ends, ends[1:]):
                    store[piece] = packed[a:b]
        store.update(zip(odd, self._ids(self.library, [" " + p for p in odd])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit bytes."""
        if not texts:
            return []
        whole = [not self.by_piece or any(a in t for a in self.added) for t in texts]
        odd = [w or odd_gaps(t) for w, t in zip(whole, texts)]
        # those that Arrow can cut, then the others
        lists = [pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " "),
                 pa.array([[t] if w else space_pieces(t) for t, w, o in zip(texts, whole, odd) if o], pa.list_(pa.string()))]
        after = np.cumsum(np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]), dtype=np.int64)
        first = np.r_[0, after[:-1]]
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        heads = distinct[codes[first]].tolist()
        later = np.ones(len(codes), dtype=bool)
        later[first] = False
        used = np.zeros(len(distinct), dtype=bool)
        used[codes[later]] = True

        pieces = distinct[used].tolist()
        ends = [word.end() if word else None for word in map(_WORD.match, pieces)]
        words = [piece[:end] for piece, end in zip(pieces, ends)]
        tails = [piece[end:] if end else "" for piece, end in zip(pieces, ends)]
        known, starts = self.memory.known, self.starts.known
        new, fresh = list(set(words).difference(known)), list(set(tails).union(heads).difference(starts))
        self._learn(known, new)
        starts.update(zip(fresh, self._ids(self.library, fresh)))
        ids = np.empty(len(distinct), dtype=object)
        ids[used] = [known[w] + starts[t] if t else known[w] for w, t in zip(words, tails)]
        of_code = ids.tolist().__getitem__
        done = [starts[h] + b"".join(map(of_code, codes[a + 1:b].tolist())) for h, a, b in zip(heads, first.tolist(), after.tolist())]
        self.memory.settle(new)
        self.starts.settle(fresh)
        out = [b""] * len(texts)
        for k, packed in zip(np.argsort(odd, kind="stable").tolist(), done):
            out[k] = packed
        return out


@lru_cache(maxsize=2)
def _encoder(spec: str) -> PieceEncoder:
    """One per worker process, so that its memory outlives a task."""
    return PieceEncoder(spec)


def pack_block(ids: np.ndarray, level: int = 3) -> bytes:
    """One block: header, plane lengths, then each byte plane of the transposed ids compressed by itself.

    Planes that hold zeros only take no bytes.
    """
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(p.tobytes()) if p.any() else b"" for p in planes]
    return MAGIC + struct.pack("<5I", len(ids), *map(len, parts)) + b"".join(parts)


def unpack_block(block: bytes) -> np.ndarray:
    """The ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token planes")
    n, *sizes = struct.unpack_from("<5I", block, 4)
    planes, at, press = np.zeros((4, n), dtype=np.uint8), 24, zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        if size:
            planes[k] = np.frombuffer(press.decompress(block[at:at + size], max_output_size=n), dtype=np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_tokens(docs: DataFrame, spec: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes the stream in ascending ``doc_id`` order under ``path``.

    ``path/blocks`` holds one row per block: ``shard``, ``chunk``, ``shard_offset``, ``n_ids``, ``data`` and the documents
    that it touches (number in the shard, id, place, length).  ``path/chunk_index`` says where each block starts in its
    shard and in the whole stream.  Shards are ranges of ``doc_id``; blocks do not cross shards.  Spark's committer
    writes both, so a task that is repeated leaves nothing behind, and any store that Spark writes will do.

    Null texts count as empty (the end id alone).  Documents without id come first; the order among equal ids is
    by text digest.  An empty table writes empty tables; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)                        # one tokenizer file
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream = _encoder(shared.value), ShardWriter(block_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, coded in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    stream.add(key, coded + end)
                    if stream.held >= 8 * block_ids:
                        yield from stream.blocks(part.column(2)[0].as_py(), last=False)
            if batch.num_rows:
                yield from stream.blocks(batch.column(2)[0].as_py(), last=False)
                shard = batch.column(2)[0].as_py()
        if stream.held:
            yield from stream.blocks(shard, last=True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    ordered = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
               .repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    rows = ordered.select("doc_id", "text", F.spark_partition_id().cast("bigint").alias("shard")).mapInArrow(work, BLOCK_ROW)
    rows.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", "chunk", "shard_offset", "n_ids")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, so as many as there are partitions
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select(
        "shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("shard_start"))
    (sizes.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("shard_offset"))
     .write.mode("overwrite").parquet(f"{path}/chunk_index"))


BLOCK_ROW = ("shard bigint, chunk bigint, shard_offset bigint, n_ids bigint, data binary, numbers array<bigint>, "
             "doc_ids array<bigint>, offsets array<bigint>, sizes array<bigint>")


class ShardWriter:
    """Collects the ids of a shard's documents and cuts them into blocks."""

    def __init__(self, block_ids: int):
        self.block_ids, self.waiting, self.held = block_ids, [], 0
        self.docs: list[tuple[int, int | None, int, int]] = []      # number, id, offset, size of those not done
        self.number = self.chunk = self.start = 0

    def add(self, key: int | None, coded: bytes) -> None:
        """Puts a document at the end."""
        self.docs.append((self.number, key, self.start + self.held, len(coded) // 4))
        self.waiting.append(coded)
        self.held += len(coded) // 4
        self.number += 1

    def blocks(self, shard: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Block rows for all full blocks, and for the rest if it is the last call."""
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        cut = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        first = 0
        for at in range(0, cut, self.block_ids):
            part = ids[at:min(at + self.block_ids, cut)]
            low, high = self.start, self.start + len(part)
            while self.docs[first][2] + self.docs[first][3] <= low:
                first += 1
            after = first
            while after < len(self.docs) and self.docs[after][2] < high:
                after += 1
            touched = zip(*self.docs[first:after])
            cells = [pa.array([v], pa.int64()) for v in (shard, self.chunk, low, len(part))]
            cells += [pa.array([pack_block(part)], pa.binary())]
            cells += [pa.array([list(c)], pa.list_(pa.int64())) for c in touched]
            yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in BLOCK_ROW.split(", ")])
            self.start, self.chunk = high, self.chunk + 1
        self.docs = [d for d in self.docs[first:] if d[2] + d[3] > self.start]
        self.waiting, self.held = [ids[cut:].tobytes()], len(ids) - cut


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a written stream: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    Every block is opened once, on its own.  Documents that lie in one block are ready then; the parts of those that
    cross a border are put together afterwards, each document in its own row.  ``ids`` are little-endian 32-bit.
    """
    starts = spark.read.parquet(f"{path}/chunk_index").select("shard", "shard_start").distinct()
    blocks = spark.read.parquet(f"{path}/blocks").drop("n_ids").select(
        "shard", "chunk", "shard_offset", "data", "numbers", "doc_ids", "offsets", "sizes")

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, chunk, low, data, *docs = (c[row].as_py() for c in batch.columns)
                packed = unpack_block(data).tobytes()
                rows = []
                for number, key, offset, size in zip(*docs):
                    part = packed[4 * max(0, offset - low):4 * (offset + size - low)]
                    whole = len(part) == 4 * size
                    rows.append((shard, number, key, offset, size, chunk, zlib.crc32(part) if whole else None,
                                 part if with_ids or not whole else None))
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], cells)

    cells = ["shard", "number", "doc_id", "offset", "n_tokens", "chunk", "ids_crc32", "ids"]
    parts = keep(blocks.mapInArrow(open_blocks, ", ".join(f"{c} bigint" for c in cells[:-1]) + ", ids binary"))
    single = parts.where("ids_crc32 is not null").drop("chunk")
    joined = (parts.where("ids_crc32 is null").groupBy("shard", "number", "doc_id", "offset", "n_tokens")
              .agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
              .withColumn("ids", F.aggregate("all", F.lit(b""), lambda a, p: F.concat(a, p["ids"])))
              .withColumn("ids_crc32", F.crc32("ids")).select(single.columns))
    out = single.union(joined).join(F.broadcast(starts), "shard")       # a row per shard, as many as partitions
    names = ["doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*names, *["ids"] * with_ids)
