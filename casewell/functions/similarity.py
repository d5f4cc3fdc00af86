"""String similarity for batches of pairs.

All scores run from 0 to 100 and rest on the longest common subsequence (LCS):
``ratio(a, b) = 200 * LCS / (len(a) + len(b))``.  Batches are scored together
with the bit-parallel LCS recurrence of Hyyro (2004), one 64-bit word per pair;
the rare pair with a longer pattern uses Python integers as bit sets, so text of
any length is scored whole.
"""

from __future__ import annotations

import sys
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this module's code with the UDFs, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64
_CELLS = 2_000_000       # match-table cells per chunk, bounds task memory


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a zero-padded matrix, and the lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    matrix = np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)
    return matrix, lengths


def _match_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every pair and position of ``b``: which positions of ``a`` hold that letter."""
    n = len(a)
    seen = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, dtype=bool)
    seen[0] = seen[a] = True
    dense = np.cumsum(seen) - 1                    # padding is symbol 0
    a_ids = dense[a]
    b_ids = dense[b] * seen[b]                     # letters absent from every ``a`` match nothing
    table = np.zeros((n, int(dense[-1]) + 1), dtype=np.uint64)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        table[rows, a_ids[:, i]] |= np.uint64(1 << i)
    table[:, 0] = 0
    return table[rows[:, None], b_ids]


def _step(state: np.ndarray, match: np.ndarray) -> np.ndarray:
    both = state & match
    return (state + both) | (state - both)


def _length_mask(lengths: np.ndarray) -> np.ndarray:
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(lengths >= WORD, full, (np.uint64(1) << lengths.astype(np.uint64) % np.uint64(WORD)) - np.uint64(1))


def _lcs_big(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        both = state & where.get(ch, 0)
        state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


def _chunks(count: int, width: int):
    size = max(1, _CELLS // max(width, 1))
    for start in range(0, count, size):
        yield slice(start, min(count, start + size))


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """LCS length of every pair."""
    out = np.zeros(len(a), dtype=np.int64)
    swap = [(y, x) if len(x) > len(y) else (x, y) for x, y in zip(a, b)]
    small = np.fromiter((len(x) <= WORD for x, _ in swap), dtype=bool, count=len(swap))
    index = np.flatnonzero(small)
    for part in _chunks(len(index), 128):
        idx = index[part]
        pa, la = _codes([swap[i][0] for i in idx])
        pb, _ = _codes([swap[i][1] for i in idx])
        match = _match_words(pa, pb)
        state = np.full(len(idx), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(pb.shape[1]):
            state = _step(state, match[:, j])
        out[idx] = np.bitwise_count(~state & _length_mask(la))
    for i in np.flatnonzero(~small):
        out[i] = _lcs_big(*swap[i])
    return out


def _lengths(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))


def _share(lcs: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total == 0, 100.0, 200.0 * lcs / np.maximum(total, 1))


def ratio_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _share(lcs_lengths(a, b), _lengths(a) + _lengths(b))


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return ratio_scores([_sorted_tokens(x) for x in a], [_sorted_tokens(y) for y in b])


def token_set_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Compares the shared words, and the shared words plus what each side adds."""
    left, right, shared = [], [], []
    for x, y in zip(a, b):
        sx, sy = set(x.split()), set(y.split())
        both = sx & sy
        left.append(" ".join(sorted(sx - both)))
        right.append(" ".join(sorted(sy - both)))
        shared.append(" ".join(sorted(both)))
    la, lb, ls = _lengths(left), _lengths(right), _lengths(shared)
    gap = (ls > 0).astype(np.int64)
    full_a, full_b = ls + gap * (la > 0) + la, ls + gap * (lb > 0) + lb
    both_added = _share(lcs_lengths(left, right) + ls + gap, full_a + full_b)
    best = np.where(ls > 0, np.maximum(_share(ls, ls + full_a), _share(ls, ls + full_b)), 0.0)
    best = np.maximum(best, both_added)
    subset = (ls > 0) & ((la == 0) | (lb == 0))
    empty = (ls == 0) & ((la == 0) | (lb == 0))
    return np.where(subset, 100.0, np.where(empty, 0.0, best))


def _windows_best(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio of ``a`` (not longer) against windows of ``b``, short ones at the edges included."""
    best = np.zeros(len(a))
    for part in _chunks(len(a), 256):
        pa, la = _codes(a[part])
        pb, lb = _codes(b[part])
        match = _match_words(pa, pb)
        mask = _length_mask(la)
        a_sizes, b_sizes = set(la.tolist()), set(lb.tolist())
        top = np.zeros(len(la))
        for start in range(pb.shape[1]):
            state = np.full(len(la), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for size in range(1, min(pa.shape[1], pb.shape[1] - start) + 1):
                end = start + size
                state = _step(state, match[:, end - 1])
                if start and size not in a_sizes and end not in b_sizes:
                    continue
                usable = (end <= lb) & ((size == la) | ((size < la) & ((start == 0) | (end == lb))))
                if usable.any():
                    score = 200.0 * np.bitwise_count(~state & mask) / (la + size)
                    top = np.where(usable, np.maximum(top, score), top)
        best[part] = top
    return best


def _windows_best_big(a: str, b: str) -> float:
    m, n = len(a), len(b)
    spans = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
    return max(200.0 * _lcs_big(a, b[i:j]) / (m + j - i) for i, j in spans)


def partial_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Ratio of the shorter text against the best window of the longer one."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs))
    small = [i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= WORD]
    if small:
        out[small] = _windows_best([pairs[i][0] for i in small], [pairs[i][1] for i in small])
        level = [i for i in small if len(pairs[i][0]) == len(pairs[i][1]) and out[i] < 100.0]
        if level:
            flipped = _windows_best([pairs[i][1] for i in level], [pairs[i][0] for i in level])
            out[level] = np.maximum(out[level], flipped)
    for i, (x, y) in enumerate(pairs):
        if len(x) > WORD:
            out[i] = _windows_best_big(x, y)
            if len(x) == len(y):
                out[i] = max(out[i], _windows_best_big(y, x))
        elif not x:
            out[i] = 100.0 if not y else 0.0
    return out


def name_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best of the four scores."""
    best = np.maximum.reduce([ratio_scores(a, b), token_sort_scores(a, b), token_set_scores(a, b)])
    todo = np.flatnonzero(best < 100.0)
    if len(todo):
        best[todo] = np.maximum(best[todo], partial_scores([a[i] for i in todo], [b[i] for i in todo]))
    return best


def _udf(scores):
    """Column function for a score; repeated pairs of a batch are scored once."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        codes, _ = pd.factorize(a.str.cat(b, sep="\x00"))
        first = np.unique(codes, return_index=True)[1]
        distinct = scores(a.iloc[first].tolist(), b.iloc[first].tolist())
        return pd.Series(distinct[codes])
    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


ratio_score = _udf(ratio_scores)
token_sort_score = _udf(token_sort_scores)
token_set_score = _udf(token_set_scores)
partial_score = _udf(partial_scores)
name_score = _udf(name_scores)
