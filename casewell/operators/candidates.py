"""Lossless candidate search for fuzzy joins.

A fuzzy join is turned into an equi-join on letter pairs ("grams").  If two
texts are similar enough, an alignment can only break a limited number of one
text's grams; so at least one of its ``broken + 1`` rarest grams is also in the
other text.  Looking up only those rarest grams keeps words that many names
share (``camp``, ``hospital``) out of the join keys, while no qualifying pair is
lost.  Cheap bounds on letters then thin the candidates before anything is
scored in Python.

Two families of scores are supported:

``sort``
    ratio of two whole texts (used on sorted tokens).  Both sides look up only
    their rarest grams.
``name``
    best of ratio, token sort, token set and partial.  One side looks up its
    rarest grams among *all* grams of the other, in both directions.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.text import sorted_tokens, squeeze

_BUCKETS = 4096          # size of the gram frequency table sent with a plan
_TABLED = 512            # text lengths with a tabulated bound
_EPS = 1e-9


def _broken(m: int, t: float, family: str) -> int:
    """Most grams of a text of length ``m`` (blanks at both ends counted in) a match can break."""
    worst = 0
    if family == "sort":
        for n in range(math.ceil(m * t / (2 - t) - _EPS), math.floor(m * (2 - t) / t + _EPS) + 1):
            lcs = math.ceil(t * (m + n) / 2 - _EPS)
            if lcs <= min(m, n):
                worst = max(worst, 2 * (m - lcs) + (n - lcs))
        return worst
    worst = max(_broken(m, t, "sort"), math.floor(m * (2 - 2 * t) / (2 - t) + _EPS))
    for w in range(1, m + 1):                       # windows: full size inside, shorter at an edge
        lcs = math.ceil(t * (m + w) / 2 - _EPS)
        if lcs <= w:
            worst = max(worst, 2 * (m - lcs) + (w - lcs) + (2 if w == m else 1))
    return worst


def _missing(m: int, t: float) -> int:
    """Most letters of the looked-up text that can be absent from its partner."""
    worst = math.floor(m * (2 - 2 * t) / (2 - t) + _EPS)
    for n in range(1, math.floor(m * (2 - t) / t + _EPS) + 1):
        lcs = math.ceil(t * (m + n) / 2 - _EPS)
        if lcs <= min(m, n):
            worst = max(worst, m - lcs)
    return worst


@lru_cache(maxsize=32)
def _bounds(t: float, family: str) -> tuple[tuple[int, ...], tuple[int, ...], int]:
    """Per length: grams that may break, letters that may be missing; and up to
    which length grams alone could lose a pair (then single letters are added)."""
    broken, missing, unsafe = [0], [0], 0
    for m in range(1, _TABLED + 1):
        broken.append(max(broken[-1], _broken(m, t, family)))
        missing.append(max(missing[-1], _missing(m, t)))
        if m + 1 - broken[m] < 1:
            unsafe = m
    return tuple(broken), tuple(missing), unsafe


def _constant(values) -> Column:
    """Number table as one literal, turned into an array once by constant folding."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def _lookup(values: tuple[int, ...], length: Column) -> Column:
    """Tabulated bound; beyond the table the text's own length is a safe bound."""
    table = _constant(values)
    return F.when(length < len(values), F.element_at(table, length + 1)).otherwise(2 * length)


def _pieces(text: Column, size: int) -> Column:
    steps = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(steps, lambda i: F.hash(F.substring(text, i, size))))


def gram_frequencies(df: DataFrame, column: str) -> np.ndarray:
    """How often grams occur, by hash bucket (at most 4096 rows reach the driver).

    Only the lookup *order* depends on it, never the result.
    """
    grams = df.select(F.explode(_pieces(F.concat(F.lit(" "), F.col(column), F.lit(" ")), 2)).alias("g"))
    counts = grams.groupBy(F.pmod("g", F.lit(_BUCKETS)).alias("b")).count().collect()
    table = np.zeros(_BUCKETS, dtype=np.int64)
    for row in counts:
        table[row["b"]] = min(row["count"], 2 ** 31 - 1)
    return table


def with_features(df: DataFrame, column: str, threshold: float, family: str, frequencies: np.ndarray,
                  shortest: int = 0) -> DataFrame:
    """Adds ``_text``, ``_len``, ``_all`` (grams), ``_rare`` (grams to look up) and ``_mask`` (letters)."""
    broken, missing, unsafe = _bounds(threshold, family)
    text = squeeze(F.col(column))
    if family == "sort":
        text = sorted_tokens(text)
    df = df.withColumn("_text", text).withColumn("_len", F.length("_text"))
    df = df.withColumn("_grams", _pieces(F.concat(F.lit(" "), F.col("_text"), F.lit(" ")), 2))
    df = df.withColumn("_chars", _pieces(F.col("_text"), 1))
    table = _constant(frequencies)
    ranked = F.array_sort(F.transform(
        "_grams", lambda g: F.struct(F.element_at(table, F.pmod(g, F.lit(_BUCKETS)) + 1).alias("n"), g.alias("g"))))
    rare = F.transform(F.slice(ranked, F.lit(1), _lookup(broken, F.col("_len")) + 1), lambda x: x["g"])
    everything, looked_up = F.col("_grams"), rare
    if unsafe >= max(shortest, 1):          # texts that short may share no gram with a partner
        everything = F.array_union("_grams", "_chars")
        looked_up = F.when(F.col("_len") <= unsafe, F.array_union(rare, "_chars")).otherwise(rare)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)))
    mask = F.aggregate("_chars", F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseOR(bit(h)))
    return (df.withColumn("_all", everything).withColumn("_rare", looked_up)
            .withColumn("_mask", mask).withColumn("_miss", _lookup(missing, F.col("_len")))
            .drop("_grams", "_chars"))


def _few_missing(mask: Column, other: Column, allowed: Column) -> Column:
    """Fewer distinct letters absent than a match allows (hash clashes only let more pairs through)."""
    return F.bit_count(mask.bitwiseAND(F.bitwise_not(other))) <= allowed


def _keyed(df: DataFrame, grams: str, lanes: list[str], names: dict[str, str]) -> DataFrame:
    """One row per lane combination and gram, keyed by a single number."""
    for lane in lanes:
        df = df.withColumn(lane, F.explode(lane))
    df = df.withColumn("_gram", F.explode(grams))
    key = F.xxhash64(*lanes, "_gram").alias("_key")
    return df.select(key, *[F.col(c).alias(a) for c, a in names.items()])


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    columns: list[str],
    threshold: float,
    family: str,
    lanes: dict[str, tuple[str, str]] | None = None,
    condition: Column | None = None,
    pair_key: tuple[str, str] = ("l_ord", "r_ord"),
) -> DataFrame:
    """Pairs (``l_*``, ``r_*``) of prepared rows that may reach ``threshold``.

    ``lanes`` names array columns (left, right) whose elements must meet as well:
    they carry the other join conditions into the key.  ``condition`` is applied
    before duplicates are removed.
    """
    lanes = lanes or {}
    kept = [*columns, "_text", "_len", "_mask", "_miss"]
    l_names, r_names = ({c: f"{p}_{c.lstrip('_')}" for c in kept} for p in ("l", "r"))

    def side(df: DataFrame, which: int, grams: str, names: dict[str, str]) -> DataFrame:
        for lane, pair in lanes.items():
            df = df.withColumn(lane, F.col(pair[which]))
        return _keyed(df, grams, list(lanes), names)

    t = threshold
    total = F.col("l_len") + F.col("r_len")
    everything = condition if condition is not None else F.lit(True)
    if family == "sort":
        # a match needs LCS >= t * total / 2, hence bounded lengths and few absent letters on both sides
        need = total * (t / 2) - _EPS
        ok = (everything & (F.least("l_len", "r_len") >= need)
              & _few_missing(F.col("l_mask"), F.col("r_mask"), F.col("l_len") - need)
              & _few_missing(F.col("r_mask"), F.col("l_mask"), F.col("r_len") - need))
        found = side(left, 0, "_rare", l_names).join(side(right, 1, "_rare", r_names), "_key").where(ok)
    else:
        one = (side(left, 0, "_rare", l_names).join(side(right, 1, "_all", r_names), "_key")
               .where(everything & _few_missing(F.col("l_mask"), F.col("r_mask"), F.col("l_miss"))))
        two = (side(left, 0, "_all", l_names).join(side(right, 1, "_rare", r_names), "_key")
               .where(everything & _few_missing(F.col("r_mask"), F.col("l_mask"), F.col("r_miss"))))
        found = one.unionByName(two)
    drop = ["_key", "l_len", "r_len", "l_mask", "r_mask", "l_miss", "r_miss"]
    return found.drop(*drop).dropDuplicates(list(pair_key))
