"""Groups of the n-gram join against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.llm import ngram_join
from casewell.llm.components import connected_components


def brute(rows, width=4, num=85, den=100):
    sets = []
    for _, text in rows:
        raw = (text or "").encode().lower().split()
        found = {tuple(raw)} if 0 < len(raw) < width else {tuple(raw[k:k + width]) for k in range(len(raw) - width + 1)}
        sets.append(found)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    return sorted(((i, len(sets[k]), groups.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, count=260):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [[r.choice(words) for _ in range(r.choice((3, 9, 40, 120)))] for _ in range(9)]
    passage = [f"p{k}" for k in range(50)]
    rows = [(None, None), (900, None), (901, " \t\n"), (902, "Äb äb"), (903, "äb äb"), (904, "one two"), (905, "ONE two")]
    for k in range(count):
        text = list(bases[r.randrange(9)])
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            text += passage
        rows.append((r.choice((k, k, k, k, max(0, k - 1), None)) if k % 9 == 0 else k, " ".join(text)))
    return rows + rows[20:24]


@pytest.mark.parametrize("leaf,block,first", [(32, 4096, 100_000), (2, 7, 0)])
def test_groups_equal_all_pairs(spark, monkeypatch, leaf, block, first):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "PAIR_STEP", 10 * block)
    monkeypatch.setattr(ngram_join, "ONE_LEAF", 2 * leaf)
    monkeypatch.setattr(ngram_join, "FREQUENT", first)
    rows = near_copies(5)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, node int, vector string")
    got = sorted((tuple(r) for r in ngram_join.jaccard_groups(docs.repartition(5)).collect()), key=str)
    assert got == brute(rows)


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_groups(docs).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert found == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none, "a", "b").agg(F.count("*")).first()[0] == 0


def test_memory_of_a_search_does_not_grow_with_its_pairs():
    import tracemalloc

    n = 3_000                                           # one shingle whose members are all alike and in components of their own
    member, size = np.arange(n), np.full(n, 200)
    vectors = np.full((n, ngram_join.GROUPS), 2, dtype="<u2")
    tracemalloc.start()
    steps = ngram_join.tree_pairs(member, size, np.zeros(n, dtype=np.int64), member, np.full(n, -1), vectors, np.zeros(n, dtype=np.int64), 85, 100)
    found = sum(len(a) for a, _ in steps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2
    assert peak < 64 << 20
