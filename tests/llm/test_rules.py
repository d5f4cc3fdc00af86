"""Quality rules, mixing, license scan and url lists on small tables, and the pipeline."""

import datetime
import math
import random
from collections import Counter

from compare import connect, difference
from casewell.llm import license_scan, mixing, ngram_join, quality, queries, url_lists

import corpus_pipeline


def distance(p, q):
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a > 0 else 0) + (b * math.log2(b / m) if b > 0 else 0)
    return math.sqrt(max(0.0, out / 2))


def test_quality_distances(spark):
    texts = ["the cat and the dog sat on the mat " * 8, "The ### $$$ %%% *** " * 12, "a b c d e f g h i j k " * 4, None, "", "x\nx\n \n x"]
    rows = [(k, t, "en" if k % 2 == 0 else None, 5) for k, t in enumerate(texts)] + [(0, texts[0], "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _n int")
    found = quality.references(docs)
    by = {r["lang"]: r for r in found}
    got = quality.judge(docs, found, quality.Limits(min_chars=1, min_words=1)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r.text or "").split()
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        again = {j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
        assert (r._n_words, r._n_repeat_words) == (len(words), len(again))
        assert r._base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))
        if words:
            ref = by.get(r.lang or "", by["*"])
            low = Counter(w.lower() for w in words)
            p = [low[w] / len(words) for w in ref["words"]]
            want = distance([*p, 1 - sum(p)], [*ref["shares"], 1 - sum(ref["shares"])])
            assert abs(r._word_distance - want) < 1e-6
    assert [r._n_dup_lines for r in got if r.doc_id == 5] == [1]
    empty = docs.limit(0)
    assert quality.judge(empty, quality.references(empty)).collect() == []


def test_mix_meets_targets(spark, small_dir):
    assert difference(queries.source_mix(spark, small_dir), connect(small_dir), queries.ORACLE["op5_source_mix"]) is None
    rows = [(k, "w " * (1 + k % 7), None if k % 3 == 0 else "ab"[k % 2], 1) for k in range(300)] + [(7, None, "a", 1), (None, "w", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.assign(docs).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r._taken for r in mine) - mine[0]._target) <= 7
        assert all(r._taken <= 3 * r._size for r in mine)
    assert mixing.mix(docs).count() == sum(len(r._positions) for r in got)
    assert mixing.assign(docs.limit(0)).collect() == []


def test_license_wording(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "x\n\n" + mit.replace("free of charge", "for a fee") + "\nend"),
            (3, "a driving license is needed to rent"), (4, None), (5, "")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, share int")).collect()}
    assert set(got) == {1, 2} and got[1].license == got[2].license == "MIT"
    assert (got[1].start, got[1].n_chars, got[1].share) == (11, 31, 1.0)
    assert "free" in got[2].missing.split() and "fee" in got[2].added.split()


def notices_of(text):
    return [(n.license, text[a:a + size]) for a, size, n in license_scan.find(text)]


def test_every_license_wording_is_told_from_its_kin():
    """All templates, alone, inside other text and over blank lines, with a changed word, against the name they stand under."""
    random.seed(3)
    for name, forms in license_scan.TEMPLATES.items():
        for form in forms:
            assert notices_of(form) == [(name, form)]
            assert notices_of(f"Some text before it, of all kinds. {form} And more text after.") == [(name, form)]
            words = form.split(" ")
            half = len(words) // 2
            folded = " ".join(words[:half]) + "\n\n# " + "\n * ".join(words[half:])
            assert [x[0] for x in notices_of(f"word\n\n{folded}\n\nend")] == [name]
            assert [x[0] for x in notices_of(f"{form}\n{form.upper()} {form}")] == [name] * 3
            plain = license_scan.words_of(form)
            if len(plain) > 20:
                loose = [k for k in range(1, len(plain) - 1) if not license_scan._decides(plain, k)]
                changed = list(plain)
                changed[random.choice(loose)] = "otherwise"
                assert [x[0] for x in notices_of(" ".join(changed))] == [name], changed


def test_other_versions_and_modifiers_are_no_notice_of_a_license():
    long = {name: forms[-1] for name, forms in license_scan.TEMPLATES.items()}
    assert notices_of(long["GPL-3.0"].replace("version 3", "version 4")) == []
    assert notices_of(long["LGPL-2.1"].replace("version 2.1", "version 2.2")) == []
    assert notices_of("Licensed under CC BY 3.0. Licensed under the Apache License, Version 1.1. This is not licensed under CC BY 4.0.") == []
    assert notices_of("All rights reserved. Licensed under CC BY 4.0.") == [
        ("All-Rights-Reserved", "All rights reserved."), ("CC-BY-4.0", "Licensed under CC BY 4.0.")]
    assert notices_of("all the rights are reserved; a driving license, copyright and permission is needed") == []
    gap = long["MIT"].replace("conditions: The", "conditions:\n\nThe")
    assert notices_of("Copyright (c) 2024 Us\n\n" + gap) == [("MIT", gap)]


def brute_notices(text):
    """Every template over every hint place by word differences alone; the one with most words in place wins."""
    words, out, low = license_scan.words_of(text), [], 0
    for here in range(len(words)):
        best = None
        for t in license_scan._templates():
            first = max(low, here - t.reach)
            found = license_scan.differences(t.words, words[first:here + t.reach])
            if here >= low and found and first + found[3] <= here < first + found[4]:
                best = max(best or (0,), (round(found[0] * len(t.words)), t.license, first + found[3], first + found[4]))
        if best:
            out.append(best[1:])
            low = best[3]
    return out


def test_hints_and_savings_lose_no_notice():
    random.seed(9)
    forms = [f for forms in license_scan.TEMPLATES.values() for f in forms]
    for _ in range(25):
        parts = []
        for form in random.sample(forms, 3):
            parts += [" ".join(random.choices("lorem ipsum the of and copyright license granted this software any".split(), k=random.randint(5, 40)))]
            parts += [" ".join(w for w in form.split(" ") if random.random() > 0.03)]
        text = "\n".join(parts)
        got = list(license_scan.notices(license_scan.words_of(text)))
        assert sorted(x.license for x in got) == sorted(x[0] for x in brute_notices(text)), text


def test_url_lists(spark, small_dir):
    assert difference(queries.url_captures(spark, small_dir), connect(small_dir), queries.ORACLE["op9_url_lists"]) is None
    day = datetime.date
    entries = [("bad.org", "add", "block", day(2024, 1, 10)), ("bad.org", "remove", "block", day(2024, 3, 1)),
               ("www.bad.org/ok", "add", "allow", day(2024, 2, 1)), (None, "add", "block", day(2024, 1, 1))]
    seen = [("http://www.BAD.org/x", day(2024, 1, 9), False), ("http://www.bad.org/x", day(2024, 1, 10), True),
            ("http://www.bad.org/ok/y?z", day(2024, 2, 2), False), ("http://www.bad.org/okay", day(2024, 2, 2), True),
            ("https://u:p@bad.org:80", day(2024, 2, 29), True), ("http://bad.org", day(2024, 3, 1), False),
            ("http://notbad.org", day(2024, 2, 1), False), (None, day(2024, 2, 1), False), ("http://bad.org", None, False)]
    captures = spark.createDataFrame(seen + seen[:2], "url string, fetched_on date, want boolean")
    got = url_lists.judge(captures, spark.createDataFrame(entries, "pattern string, action string, verdict string, dated date"))
    assert got.count() == len(seen) + 2 and got.where("want <> blocked").collect() == []
    assert url_lists.judge(captures.limit(0), spark.createDataFrame(entries, "pattern string, action string, verdict string, dated date")).collect() == []


def test_pipeline_keeps_clean_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, small_dir)
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [r.doc_id for r in labels.where("quality = 1").join(docs.where("length(text) > 200"), "doc_id").collect()]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    one = stages["n-gram join"](spark, good, small_dir)
    assert one.columns == docs.columns and one.count() == one.select("doc_id").distinct().count()


def test_url_paths_keep_their_case(spark):
    day = datetime.date(2024, 1, 1)
    entries = spark.createDataFrame([("Example.com/News", "add", "block", day), ("OTHER.org", "add", "block", day)],
                                    "pattern string, action string, verdict string, dated date")
    rows = [("http://example.COM/News/1", True), ("http://example.com/news/1", False), ("http://a.other.org/X", True)]
    captures = spark.createDataFrame([(u, day, w) for u, w in rows], "url string, fetched_on date, want boolean")
    got = url_lists.judge(captures, entries)
    assert got.count() == 3 and got.where("want <> blocked").collect() == []


def test_every_language_has_a_reference(spark):
    r = random.Random(6)
    latin = [(k, " ".join(r.choice(("cat", "dog", "sat", "mat")) + str(r.randrange(900)) for _ in range(90)), f"l{k % 70}") for k in range(140)]
    small = [(200 + k, " ".join("".join(chr(0x1200 + r.randrange(60)) for _ in range(5)) for _ in range(60)), "am") for k in range(2)]
    docs = spark.createDataFrame(latin + small + [(300, latin[0][1], "*"), (301, latin[1][1], None)], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in quality.keep_good(docs, quality.Limits(words=1.0)).collect()]
    assert sorted(kept) == [*range(140), 200, 201, 300, 301]


def test_a_small_language_is_not_its_own_yardstick(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(("the", "cat", "and", "dog", "sat", "mat")) + r.choice(("", "s", str(r.randrange(9)))) for _ in range(n))
    junk = lambda: " ".join(r.choice("#$%&*") * r.randrange(3, 9) + str(r.randrange(999)) for _ in range(80))
    ethiopic = lambda: " ".join("".join(chr(0x1200 + r.randrange(60)) for _ in range(5)) for _ in range(60))
    rows = [(k, prose(120), "en") for k in range(40)] + [(100 + k, junk(), "xx") for k in range(3)] + [(110, junk(), "en")]
    rows += [(200 + k, ethiopic(), "am") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in quality.keep_good(docs, quality.Limits(words=1.0, least_reference=2_000)).collect()}
    assert kept == {*range(40), 200, 201, 202}


def test_columns_named_like_the_operators_own(spark):
    text = " ".join(f"word{k}" for k in range(30))
    names = ["doc_id", "text", "lang", "source", "_text", "_size", "_id", "_kept", "_position", "a.b", "given"]
    rows = [(k, text + f" {k} end of it {k}", "en", "s", "t", 1, 2, False, 0.5, "dot", 9) for k in range(6)]
    docs = spark.createDataFrame(rows, names)
    same = sorted(map(tuple, docs.collect()))
    assert quality.keep_good(docs).columns == names
    assert sorted(map(tuple, quality.keep_good(docs, quality.Limits(words=1.0, classes=1.0)).collect())) == same
    judged = quality.judge(docs, quality.reference_table(docs))
    assert judged.columns.count("_kept") == 1 and {x["_text"] for x in judged.collect()} == {"t"}
    mixed = mixing.mix(docs)
    assert mixed.columns == names and {x["_size"] for x in mixed.collect()} == {1}
    assert mixing.assign(docs).columns.count("_size") == 1
    one = ngram_join.keep_one(docs)
    assert one.columns == names and sorted(map(tuple, one.collect())) == same
    entries = spark.createDataFrame([("bad.org/a", "add", "block", datetime.date(2024, 1, 1))], "pattern string, action string, verdict string, dated date")
    pages = spark.createDataFrame([("http://bad.org/a/b", datetime.date(2024, 2, 1), "u", "b", 1)], "url string, fetched_on date, _url string, _best string, blocked int")
    got = url_lists.judge(pages, entries)
    assert got.columns == ["url", "fetched_on", "_url", "_best", "matched_pattern", "matched_verdict", "blocked"]
    assert got.first().blocked is True and got.first()["_best"] == "b"


def test_very_long_urls(spark):
    day = datetime.date(2024, 1, 1)
    entries = spark.createDataFrame([("bad.org/a/b", "add", "block", day), ("w.bad.org/a", "add", "allow", day)], "pattern string, action string, verdict string, dated date")
    tail = "/".join(["s"] * 30_000)
    rows = [("http://bad.org/a/b/" + tail, True), ("http://bad.org/a/c/" + tail, False), ("http://" + "x." * 3000 + "w.bad.org/a/b", False),
            ("http://" + "x." * 3000 + "bad.org/a/b", False), ("http://bad.org/a/b", True)]
    captures = spark.createDataFrame([(u, day, w) for u, w in rows], "url string, fetched_on date, want boolean")
    got = url_lists.judge(captures, entries)
    assert got.count() == 5 and got.where("want <> blocked").collect() == []
