"""Token counts by a two-tier lookup of piece lengths."""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import LONGEST_PIECE, PieceMemory, text_batches

FREQUENT = 50_000               # pieces whose lengths every worker is sent
COUNTED = 400_000               # pieces that a task counts at a time; the rarer half goes when there are more

_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")
_ODD_GAP = re.compile(r" (?: |\Z)|\A ")


def space_pieces(text: str) -> list[str]:
    """Cuts at single spaces; longer runs stay inside a piece, as they may become one token with what follows."""
    return _CUT.split(text) if _ODD_GAP.search(text) else text.split(" ")


@lru_cache(maxsize=1)
def _memory(run: str) -> PieceMemory:
    """Lengths that this worker process knows in a run; the broadcast table goes in once."""
    return PieceMemory()


@lru_cache(maxsize=2)
def _model(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def piecewise(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether counts of pieces add up: no entry holds a space mark after another sign, spaces are kept as they are."""
    names = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    inner = any("▁" in n.lstrip("▁") for n in names)
    probes = ("a  b", " a", "a ", "  ", "ﬁ Ａ")
    kept = all(model.decode(model.encode(p)) == p for p in probes)
    return not inner and kept


def frequent_pieces(docs: DataFrame, text_col: str = "text", limit: int = FREQUENT) -> list[str]:
    """The pieces most frequent in all texts, at most ``limit`` of at most LONGEST_PIECE characters.

    Every task counts the pieces of its texts and hands on its ``limit`` most frequent; those lists are added up.  A task
    that meets more than COUNTED pieces forgets the rarer half, so rare pieces may be missing: they are encoded by the workers.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(space_pieces(text))
                if len(seen) > COUNTED:
                    seen = Counter(dict(_short(seen, COUNTED // 2)))
        top = _short(seen, limit)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         ["piece", "n"])

    text = F.col(text_col).cast("string")
    counts = docs.where(text.isNotNull()).select(text.alias("text")).mapInArrow(count, "piece string, n bigint")
    rows = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(limit).collect()
    return [r["piece"] for r in rows]


def _short(seen: Counter[str], limit: int) -> list[tuple[str, int]]:
    """The most frequent of the pieces that are short enough to be remembered."""
    return Counter({p: n for p, n in seen.items() if len(p) <= LONGEST_PIECE}).most_common(limit)


def count_tokens(docs: DataFrame, model_file: str, over: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a sentencepiece model, without begin and end marks.

    Result per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``over`` tokens).
    The first tier is a broadcast table of at most FREQUENT piece lengths, the most frequent of all texts; misses are encoded by
    the worker and kept in a memory bounded in bytes.  No piece is shuffled but the tasks' lists of frequent ones.  The library puts one space before a text, so every piece starts with one; a
    model whose entries could join two pieces encodes whole texts instead.

    Null texts count as empty (0 bytes, 0 tokens).  Repeated rows and null ids are kept; other columns are ignored;
    an empty table gives an empty result; any text length is counted whole.
    """
    with open(model_file, "rb") as f:
        proto = f.read()
    context = docs.sparkSession.sparkContext
    by_piece = piecewise(_model(proto))
    frequent = frequent_pieces(docs, text_col) if by_piece else []
    sizes = array("H", map(len, _model(proto).encode(frequent, num_threads=1))) if frequent else array("H")
    shared = context.broadcast((proto, frequent, sizes))               # one model file, at most FREQUENT short pieces
    run = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces, lengths = shared.value
        model, memory = _model(own), _memory(run)
        known = memory.known
        if pieces and pieces[0] not in known:
            known.update(zip(pieces, lengths))
            memory.settle(pieces)
        for keys, texts in text_batches(batches):
            # a written space mark is the same as a space to the library, so such texts are not cut
            cut = [space_pieces(t) if by_piece and t and "▁" not in t else [] for t in texts]
            new = list(set().union(*cut).difference(known))
            known.update(zip(new, map(len, model.encode(new, num_threads=1))))
            counts = [sum(map(known.__getitem__, c)) if c else len(model.encode(t)) for c, t in zip(cut, texts)]
            memory.settle(new)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([c > over for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
