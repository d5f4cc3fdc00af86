"""The pipeline and the choice within groups against brute force."""

import base64
import hashlib
import math
import random
import unicodedata
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken
from test_rules import distance

from casewell.llm import mixing, ngram_join

import corpus_pipeline


def linked_groups(texts, width=4, num=85, den=100):
    """Lists of places, one per group; wordless texts are in none."""
    sets = []
    for t in texts:
        raw = (t or "").encode().lower().split()
        sets.append({tuple(raw)} if 0 < len(raw) < width else {tuple(raw[k:k + width]) for k in range(len(raw) - width + 1)})
    left, out = {k for k, s in enumerate(sets) if s}, []
    while left:
        todo = [left.pop()]
        group = []
        while todo:
            a = todo.pop()
            group.append(a)
            near = {b for b in left if den * (n := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - n)}
            left -= near
            todo.extend(near)
        out.append(group)
    return out


def one_per_group(rows):
    """``rows`` are (id, text, ...)."""
    chosen = [k for k, r in enumerate(rows) if not (r[1] or "").split()]
    for group in linked_groups([r[1] for r in rows]):
        chosen.append(min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1])))
    return [rows[k] for k in chosen]


def test_each_group_keeps_one_row(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "some other words stand in here")
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (9, b, 4), (7, c, 5), (12, c, 6), (None, a, 7), (None, "only null ids name this", 8),
            (None, "only null ids name this", 9), (20, " ", 10), (21, None, 11), (30, "ONE more text", 12), (30, "one more text", 13),
            (40, "a text of its own", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = ngram_join.keep_one(docs.repartition(3)).collect()
    cut = lambda found: sorted(((r[0], r[1]) for r in found), key=str)
    assert cut(got) == cut(one_per_group(rows))
    assert {r.node for r in got} - {8, 9} == {1, 3, 5, 10, 11, 12, 14}


KINDS = {"Ll": 0, "Lu": 1}


def classes(text):
    out = [0] * 5
    for ch in text:
        if ch not in " \t\n\x0b\x0c\r":
            out[KINDS.get(unicodedata.category(ch), 2 if ch in "0123456789" else 3 if ch in "#*$%&|<>" else 4)] += 1
    return out


def good(rows):
    """Rows (id, text, lang, source) that pass the quality rules."""
    words = [(r[1] or "").split() for r in rows]
    counts = defaultdict(Counter)
    signs = defaultdict(lambda: [0] * 5)
    for r, w in zip(rows, words):
        counts[r[2] or ""].update(x.lower() for x in w)
        signs[r[2] or ""] = [x + y for x, y in zip(signs[r[2] or ""], classes(r[1] or ""))]
    out = []
    for r, w in zip(rows, words):
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
        if len(w) < 10 or 100 * len(again) > 20 * len(w):
            continue
        lang, mine = r[2] or "", classes(r[1])
        if sum(mine) >= 200 and distance([x / sum(mine) for x in mine], [x / sum(signs[lang]) for x in signs[lang]]) > 0.30:
            continue
        top = sorted(((n, x) for x, n in counts[lang].items() if n > 1), key=lambda t: (-t[0], t[1]))[:30]
        low, total = Counter(x.lower() for x in w), sum(counts[lang].values())
        p, q = [low[x] / len(w) for _, x in top], [n / total for n, _ in top]
        if len(w) >= 40 and distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]) > 0.45:
            continue
        out.append(r)
    return out


def mixed(rows):
    """Rows in order of training position, as often as they are taken."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float(mixing.WEIGHTS[k % 3]) for k, s in enumerate(names)}
    ramp = {s: mixing.RAMPS[k % 3] for k, s in enumerate(names)}
    left, open_names, target = float(sum(sizes.values())), set(names), {}
    while open_names:
        share = left / sum(weight[s] for s in open_names)
        full = {s for s in open_names if 3 * sizes[s] <= share * weight[s]}
        for s in full or open_names:
            target[s] = float(3 * sizes[s]) if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_names = open_names - full if full else set()
    place = {r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16) for r in rows}
    out, before = [], Counter()
    for r in sorted(rows, key=lambda r: (place[r], r[0], hashlib.md5(r[1].encode()).hexdigest())):
        n, s = len(r[1].split()), r[3]
        for e in range(3):
            middle = before[s] + n / 2 + e * sizes[s]
            if middle < target[s]:
                w0, w1 = ramp[s]
                want = middle / target[s] * (w0 + w1) / 2
                out.append((2 * want / (w0 + math.sqrt(w0 * w0 + 2 * (w1 - w0) * want)), r))
        before[s] += n
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def test_run_equals_brute_force(spark, small_dir, tmp_path):
    names = ["doc_id", "text", "lang", "source"]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(*names)
    rows = [tuple(r) for r in docs.collect()]
    r = random.Random(3)
    long = [x for x in rows if len((x[1] or "").split()) > 60]
    fresh = max(x[0] for x in rows) + 1
    for k in range(12):
        a, b, c = r.sample(long, 3)
        # an id for texts of several groups, copies of them with other ids, and near copies
        rows += [(a[0], b[1], b[2], b[3]), (fresh + 3 * k, b[1], b[2], a[3]), (fresh + 3 * k + 1, c[1] + " end", c[2], c[3]),
                 (fresh + 3 * k + 2, c[1], c[2], c[3])]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    one = one_per_group(good(rows))
    assert 50 < len(one) < len(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in mixed(one):
        ids = library.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
