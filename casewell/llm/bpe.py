"""Byte-level BPE: encoding by merge ranks with a segment tree, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import PieceMemory, space_pieces, text_batches

TREE_CELLS = 1 << 18            # tree cells that one vectorised step holds
LONG = 512                      # from this many bytes a pre-token gets a tree of its own
NONE = np.int64(1) << 62        # no pair here
KNOWN_BYTES = 64 << 20          # of pieces that a worker remembers; reused workers keep them beside the steps that follow
PORTION = 256                   # texts encoded side by side


class RankedMerges:
    """A vocabulary of byte strings with ranks, and the pairs of tokens whose join is in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.one = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pairs = dict(pairs)
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], dtype=np.int64)
        self.made = np.array([r for _, r in pairs] + [0], dtype=np.int64)
        lengths = np.zeros(self.size + 1, dtype=np.int64)
        for t, r in ranks.items():
            lengths[r + 1] = len(t)
        self.ends = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), dtype=np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or NONE."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of every pre-token, as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(w) >= LONG:
                out[k] = self._one_long(w)
            elif w:
                by_size.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, members in by_size.items():
            step = max(1, TREE_CELLS // (2 * width))
            for at in range(0, len(members), step):
                part = members[at:at + step]
                for k, ids in zip(part, self._many([words[j] for j in part], width)):
                    out[k] = ids
        return out

    def _many(self, words: list[bytes], width: int) -> list[bytes]:
        """Merges many short pre-tokens side by side, one merge of each per step.

        Row w of ``tree`` is the segment tree over the byte positions of word w.  A leaf holds
        rank * width + position of the pair that starts there, so the root is the leftmost pair of lowest rank.
        """
        n, bits = len(words), width.bit_length() - 1
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        ids = self.one[flat]
        place = np.arange(width)
        after = np.where(place + 1 < size[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        rank[after[:, :-1] == width] = NONE
        tree[:, width:2 * width - 1] = np.where(rank < NONE, rank * width + place[:-1], NONE)
        for low in (width >> k for k in range(1, bits + 1)):
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        alive = place < size[:, None]
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            best = tree[rows, 1]
            at, made = best % width, best // width
            gone = after[rows, at]
            ids[rows, at] = made
            alive[rows, gone] = False
            behind = after[rows, gone]
            after[rows, at] = behind
            has = behind < width
            before[rows[has], behind[has]] = at[has]
            self._put(tree, rows, gone, np.full(rows.size, NONE), bits, width)
            new = np.full(rows.size, NONE)
            new[has] = self.rank_of(made[has], ids[rows[has], behind[has]])
            self._put(tree, rows, at, np.where(new < NONE, new * width + at, NONE), bits, width)
            front = before[rows, at]
            had = front >= 0
            r, f = rows[had], front[had]
            new = self.rank_of(ids[r, f], made[had])
            self._put(tree, r, f, np.where(new < NONE, new * width + f, NONE), bits, width)
            rows = rows[tree[rows, 1] < NONE]
        packed, counts = ids[alive].astype("<u4").tobytes(), alive.sum(axis=1) * 4
        ends = np.cumsum(counts)
        return [packed[e - c:e] for e, c in zip(ends.tolist(), counts.tolist())]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, bits: int, width: int) -> None:
        """Sets a leaf of each row and the minima above it."""
        node = at + width
        tree[rows, node] = value
        for _ in range(bits):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _one_long(self, word: bytes) -> bytes:
        """The same merges for one long pre-token, with a plain list as its tree."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        pairs, size, none = self.pairs, self.size, int(NONE)
        ids = [int(self.one[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for k in range(n - 1):
            r = pairs.get(ids[k] * size + ids[k + 1])
            if r is not None:
                tree[width + k] = r * width + k
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, rank: int | None) -> None:
            node = at + width
            tree[node] = none if rank is None else rank * width + at
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        alive = bytearray(b"\1") * n
        while tree[1] < none:
            made, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], alive[gone] = made, 0
            behind = after[at] = after[gone]
            put(gone, None)
            put(at, None if behind >= n else pairs.get(made * size + ids[behind]))
            if behind < n:
                before[behind] = at
            if before[at] >= 0:
                put(before[at], pairs.get(ids[before[at]] * size + made))
        return np.array([i for i, a in zip(ids, alive) if a], dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        if not len(ids):
            return b""
        start, size = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return self.bytes[np.arange(size.sum()) + shift].tobytes()


class Encoder:
    """Encodes texts piece by piece and remembers the pieces met so far, within a bound."""

    def __init__(self, merges: RankedMerges):
        self.merges, self.memory = merges, PieceMemory(KNOWN_BYTES)

    def _learn(self, store: dict[str, bytes], lead: str, missing: list[str]) -> None:
        words: dict[bytes, int] = {}
        parts = []
        for piece in missing:
            parts.append([words.setdefault(w.encode("utf-8", "surrogatepass"), len(words))
                          for w in self.merges.split(lead + piece)])
        ids = self.merges.encode_words(list(words))
        for piece, part in zip(missing, parts):
            store[piece] = b"".join([ids[k] for k in part])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit bytes."""
        cut = [space_pieces(t) for t in texts]
        rest = [c[1:] for c in cut]
        known, first = self.memory.known, {}
        new = list(set().union(*rest).difference(known))
        self._learn(known, " ", new)
        self._learn(first, "", list({c[0] for c in cut}))
        for c, r in zip(cut, rest):
            yield first[c[0]] + b"".join(map(known.__getitem__, r))
        self.memory.settle(new)


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """One per worker process, so that its memory outlives a task."""
    pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
    return Encoder(RankedMerges({base64.b64decode(t): int(r) for t, r in pairs}, pattern))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = True) -> DataFrame:
    """Encodes every text by merge ranks and decodes the ids again.

    ``vocabulary`` is a file with one base64 token and its rank per line; ``pattern`` cuts a text into
    pre-tokens, each merged on its own.  Result per row: ``doc_id``, ``n_tokens``, ``ids`` and ``decoded``
    (binary, only ``with_ids``), ``ids_sha256``, ``decoded_sha256``.

    The tasks cut texts before spaces, encode each distinct piece once per batch (all new pre-tokens side by side)
    and remember a bounded number.  No shuffle; a lost executor repeats its partitions only.
    Null texts count as empty: no tokens and the digests of nothing.  Repeated rows and null ids are kept as they
    are; other columns are ignored; an empty table gives an empty result; any text length is encoded whole.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())     # one vocabulary file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        merges = encoder.merges
        for keys, texts in text_batches(batches, PORTION):
            ids, back, counts, sums, checks = [], [], [], [], []
            for coded in encoder.encode(texts):
                plain = merges.decode(np.frombuffer(coded, dtype="<u4"))
                counts.append(len(coded) // 4)
                sums.append(hashlib.sha256(coded).hexdigest())
                checks.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    ids.append(coded)
                    back.append(plain)
            cells = [keys, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(checks, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cells += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cells, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids binary, decoded binary"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
