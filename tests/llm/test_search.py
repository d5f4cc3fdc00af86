"""Lexical search, spelling variants and top-k products against brute force."""

import math
import re
import zlib

import numpy as np
import pytest

import compare
from casewell.llm import lexical_search, norm_search, queries, spelling_groups

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, limit):
    texts = [(i, [t.translate(LOWER) for t in TERM.findall(x or "")]) for i, x in docs]
    texts = [(i, t) for i, t in texts if t]
    total, number, out = sum(len(t) for _, t in texts), len(texts), []
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, x in items:
        asked.setdefault(i, set()).update(t.translate(LOWER) for t in TERM.findall(x or ""))
    for item, terms in asked.items():
        found = []
        for i, t in texts:
            m = 50 + 50 * len(t) * number // total
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m))
                    for x in terms if x in t)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:limit])]
    return sorted(out, key=str)


def texts_for_search(r, rows):
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "x2", "日本"]
    share = 1 / np.arange(1, len(words) + 1)
    return [(k, " ".join(r.choice(words, size=int(r.integers(1, 60)), p=share / share.sum()))) for k in range(rows)]


@pytest.mark.parametrize("shard, block", [(300, 4), (1_000_000, 64)])
def test_rank_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "SAMPLE_LEAST", 8)
    r = np.random.default_rng(3)
    docs = texts_for_search(r, 300) + [(5, "W1 w2,w3--W1"), (None, "w1 w1"), (900, None), (901, ""), (902, " ,;"), (None, "w1 w1")]
    docs += [(1000 + k, "w7 w9 ÉTÉ") for k in range(90)]
    items = [(1, "w1 W3 w50 w7"), (2, "été Été ÉTÉ"), (2, "日本 w2"), (3, "none such"), (4, None), (None, "w1 x2")]
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, item_id string, n int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for limit in (7, 50):
        got = sorted((tuple(x) for x in lexical_search.rank(table, asked, limit, item_bytes=40).collect()), key=str)
        assert got == brute_rank(docs, items, limit)
    assert lexical_search.rank(table.limit(0), asked).collect() == []
    assert lexical_search.rank(table, asked.limit(0)).collect() == []


def test_blocks_are_skipped(monkeypatch):
    """Blocks whose summaries fall short are never weighed."""
    r = np.random.default_rng(1)
    sizes = r.integers(3, 9, 4000)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    terms = np.concatenate([np.sort(r.choice(200, n, replace=False)) for n in sizes])
    gains = r.integers(1, 1000, len(terms)) * np.repeat(r.choice([1, 1, 1, 20], 4000), sizes)
    shard = lexical_search.Shard(np.arange(4000), starts, terms, gains, np.arange(200))
    weighed = []
    scores = shard.scores
    monkeypatch.setattr(shard, "scores", lambda docs, *more: (weighed.append(len(docs)), scores(docs, *more))[1])
    item = np.arange(0, 40)
    mark = np.zeros((1, 200), dtype=bool)
    mark[0, item] = True
    whole = scores(np.arange(4000), np.zeros(4000, dtype=np.int64), mark)
    best = np.lexsort((np.arange(4000), -whole))[:10]
    _, found, _ = lexical_search.search_shard(shard, [item], 200, np.array([int(whole[best[-1]])]), 10)
    assert found.tolist() == best.tolist() and 0 < sum(weighed) < 0.8 * (whole > 0).sum()


def test_long_texts_in_portions(monkeypatch):
    text = "Ab,c9 é\n" * 50
    whole = lexical_search.count_terms(text.encode())
    monkeypatch.setattr(lexical_search, "PORTION", 7)
    assert lexical_search.count_terms(text.encode()) == whole == {b"ab": 50, b"c9": 50, "é".encode(): 50}


def brute_variants(docs, shortest=5, least=3, one_in=97):
    counts = {}
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= shortest:
                counts[w] = counts.get(w, 0) + 1
    n = {w: c for w, c in counts.items() if c >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    links = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def word_docs():
    r = np.random.default_rng(7)
    stems = ["colour", "color", "colours", "behaviour", "behavior", "Straße", "éééééé", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "abcdf", "bbcde",
             "abde", "naïveté", "x" * 60, "x" * 61, "x" * 30 + "y" + "x" * 30, "q" * 48, "q" * 49, "q" * 47 + "r", "zz÷zz×z", "ÀÿÀÿÀÿ"]
    for w in list(stems):
        for _ in range(3):
            k = int(r.integers(len(w)))
            stems += [w[:k] + w[k + 1:], w[:k] + "abé"[int(r.integers(3))] + w[k:], w[:k] + "o" + w[k + 1:]]
    docs = [(k, ", ".join(r.choice(stems, 40))) for k in range(60)]
    return docs + [(None, "Colour colour COLOUR color"), (3, "colour colour"), (3, "colour colour"), (61, None), (62, ""), (63, "1 2 3")]


@pytest.mark.parametrize("one_in, depth", [(97, 48), (3, 48), (0, 6), (5, 0)])
def test_variants_equal_brute_force(spark, one_in, depth):
    docs = word_docs()
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    words = spelling_groups.text_words(spelling_groups.F.col("text"))
    if one_in:
        words = spelling_groups.F.transform(words, lambda w: spelling_groups.misspell(
            w, spelling_groups.F.coalesce(spelling_groups.F.col("doc_id").cast("string"), spelling_groups.F.lit("")), one_in))
    counted = spelling_groups.count_words(table, words, 5, 3)
    got = sorted((tuple(x) for x in spelling_groups.variant_forms(counted, trie_depth=depth).collect()), key=str)
    assert got == brute_variants(docs, one_in=one_in)


def test_variants_of_documents(spark):
    docs = word_docs()
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string")
    assert sorted((tuple(x) for x in spelling_groups.spelling_variants(table).collect()), key=str) == brute_variants(docs)
    assert spelling_groups.spelling_variants(table.limit(0)).collect() == []


def brute_products(rows, step, limit, scale=64):
    good = [(k, i, [math.floor(scale * x) for x in v]) for k, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) and abs(scale * x) < 2 ** 62 for x in v)]
    out = []
    for k, i, q in good:
        if i is None or i % step:
            continue
        found = sorted((-max(-2 ** 63 + 1, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, p)))), j is None, j or 0, j) for m, j, p in good if m != k)
        out += [(i, n + 1, f[3], -f[0]) for n, f in enumerate(found[:limit])]
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(9)
    rows = [(k, (r.standard_normal(6) * r.choice([0.1, 1, 8])).tolist()) for k in range(400)]
    rows += [(500 + k, rows[0][1]) for k in range(30)] + [(20, rows[3][1]), (600, [0.0] * 6), (620, []), (621, None), (640, [None] * 6),
             (641, [float("inf")] + [0.0] * 5), (660, [1.0, 2.0]), (None, rows[5][1]), (None, rows[5][1]), (680, [9.0] * 8)]
    return rows


@pytest.mark.parametrize("bucket, group", [(16, 1 << 10), (1024, 1 << 24)])
def test_products_equal_brute_force(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(norm_search, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(norm_search, "GROUP_BYTES", group)
    monkeypatch.setattr(norm_search, "SAMPLE_LEAST", 20)
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    asked = norm_search.F.col("vec_id") % 20 == 0
    got = sorted((tuple(x) for x in norm_search.top_products(table.repartition(3), asked, 20).collect()), key=str)
    assert got == brute_products(rows, 20, 20)
    assert norm_search.top_products(table.limit(0), asked).collect() == []
    assert norm_search.top_products(table.where("vec_id = 3"), asked).collect() == []


def test_products_of_huge_components(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [2.0 ** 40, -1.0]), (2, [-(2.0 ** 40), 3.0]), (20, [2.0 ** 30, 2.0 ** -6]), (4, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = norm_search.top_products(table, norm_search.F.col("vec_id") % 20 == 0, 20)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_products(rows, 20, 20)


def test_coordinates_prune():
    """At high thresholds few vectors of a bucket are left, none of them lost."""
    r = np.random.default_rng(4)
    v = np.floor(64 * r.standard_normal((2000, 8))).astype(np.int64)
    norms = np.linalg.norm(v, axis=1)
    bucket = norm_search.Bucket(v, norms)
    near = np.floor(v[7] * 1.01).astype(np.int64)
    norm = float(np.linalg.norm(near))
    left = bucket.by_coordinate(near, norm, 0.97)
    cosines = v @ near / norms / norm
    assert left is not None and len(left) < 700 and set(np.flatnonzero(cosines >= 0.97)) <= set(left.tolist())


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_spelling_groups", "op13_norm_buckets"])
def test_queries_equal_sql(spark, small_dir, name):
    assert compare.difference(queries.QUERIES[name](spark, small_dir), compare.connect(small_dir), queries.ORACLE[name]) is None
