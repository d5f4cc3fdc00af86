"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewell.settings import ensure_checkpoint_dir

#: Fixed value: characters that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_GAPS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder, so that lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its ``_`` columns (and those with dots) renamed, so that an operator's own ``_`` names are free, and the name each
    column has there."""
    start = "given"
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    names = {c: f"{start}{k}" if c.startswith("_") or set(c) & {".", "`"} else c for k, c in enumerate(df.columns)}
    return df.withColumnsRenamed(names), names


def as_given(names: dict[str, str], without: Iterable[str] = ()) -> list[Column]:
    """The columns of ``set_aside`` under their first names; those named in ``without`` are left out."""
    return [F.col(now).alias(first) for first, now in names.items() if first not in set(without)]


def word_list(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


_CUT = re.compile(r" (?=\S)")
_ODD_GAP = re.compile(r" (?:\s|\Z)")


def space_pieces(text: str) -> list[str]:
    """Cuts before every space that a visible character follows; each piece but the first has lost that space.

    A tokenizer whose tokens hold a space at their start only can treat the pieces one by one.
    """
    return _CUT.split(text) if odd_gaps(text) else text.split(" ")


def odd_gaps(text: str) -> bool:
    """Whether a text has spaces that ``space_pieces`` does not cut at."""
    return _ODD_GAP.search(text) is not None


CACHE_BYTES = 160 << 20         # what a worker's memory of pieces may hold
LONGEST_PIECE = 64              # characters of a piece that is worth remembering
_SLOT_BYTES = 104               # a key's place in a dictionary that is two thirds full at least


class PieceMemory:
    """What a worker knows of pieces of text, within a bound.

    A batch may add all it needs to ``known`` and then says ``settle``: pieces over LONGEST_PIECE characters (whole texts, where a
    script has no spaces) and batches that find no room leave again.  ``limit`` is a bound below CACHE_BYTES.
    """

    def __init__(self, limit: int | None = None) -> None:
        self.known: dict = {}
        self.held, self.limit = 0, limit

    def size(self, pieces: Iterable[str]) -> int:
        """Bytes that pieces take with what is known of them."""
        pieces = list(pieces)
        return (sum(map(sys.getsizeof, pieces)) + sum(map(sys.getsizeof, map(self.known.__getitem__, pieces)))
                + _SLOT_BYTES * len(pieces))

    def settle(self, new: Iterable[str]) -> None:
        """Keeps or forgets the pieces that a batch has added: the short ones stay if there is room for all of them."""
        short = [p for p in new if len(p) <= LONGEST_PIECE]
        size = self.size(short)
        stay = self.held + size <= min(CACHE_BYTES, self.limit or CACHE_BYTES)
        if stay:
            self.held += size
        for piece in new:
            if not stay or len(piece) > LONGEST_PIECE:
                del self.known[piece]


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of Arrow batches in small portions; a null text is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
