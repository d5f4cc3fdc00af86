"""Main texts on hand-made pages; vector groups against all pairs."""

import numpy as np

from casewell.llm import main_text, vector_dedup

SHELL = ('<html><head><title>T</title><script>var t="</p><article>";</script></head><body><nav><a href="/">Home</a></nav>'
         '<div class="cookie-notice">We use cookies on this site</div>%s<footer>&copy; us</footer></body></html>')
STORY = "<p>One two three four &amp; five six seven.</p>\n<p>Eight  nine\n<b>ten</b> eleven twelve thirteen<br>fourteen.</p>"
WANT = "One two three four & five six seven.\nEight nine ten eleven twelve thirteen fourteen."


def test_main_text_forms(spark):
    labelled = SHELL % f"<article>{STORY}<aside>Buy now</aside><div id='comments'><p>Nice text</p></div></article>"
    weights = main_text.fit(iter([labelled] * 30))
    plain = SHELL % f"<ul><li><a>Menu one</a></li><li><a>Menu two</a></li></ul><div class='content'>{STORY}</div>"
    odd = SHELL % f"<main><h1>Head</h1><p>{'x ' * 50}<p>y &lt;b&gt; &#233;<form><input name=q>Search</form><p>z"
    rows = [(1, "u", labelled), (2, None, plain), (3, "u", odd), (4, "u", ""), (5, "u", None), (None, "u", "a < b"),
            (1, "u", labelled), (7, "u", "<p " + "a" * 50)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in main_text.extract(pages.coalesce(1), weights).collect()]
    texts = [g[2] for g in got]
    assert texts[0] == texts[1] == texts[6] == WANT and texts[3:5] == ["", ""] and texts[5] == "a < b"
    assert texts[2] == "Head\n" + " ".join("x" * 50) + "\ny <b> é\nz"
    assert [g[0] for g in got] == [r[0] for r in rows] and [g[1] for g in got] == [r[1] for r in rows]
    assert all(g[3] == len(g[2]) for g in got)
    assert main_text.extract(pages.limit(0), weights).collect() == []


def test_main_text_of_misleading_marks():
    story = f"<p>{'word ' * 30}end.</p><p>{'more ' * 20}</p>"
    want = f"{'word ' * 30}end.\n{'more ' * 20}".strip()
    lead = story.replace("<p>", '<p class="lead notice-free">')
    nested = f'<section class="comments"><article class="comment"><p>{"nice " * 80}</p></article></section>'
    forms = [f'<div style="overflow:hidden">{story}</div>', f'<article style="overflow:hidden">{story}</article>',
             f'<div class="content with-sidebar">{story}</div>', f"<div>{lead}</div>", f'<section id="main-header-story">{story}</section>',
             f'<div data-class="tags">{story}</div>', f"<script><!-- x=1; </script>{story}", f'<div class="header">{story}</div>',
             f'<article><div class="post share-enabled">{story}</div></article>', f'<article>{story}{nested}</article>',
             f'<form id="page"><nav><a>Home</a></nav><div>{story}</div></form>', f"<article>{story}<div hidden>unseen words</div></article>",
             f'<div class="site-header">A B C D</div><div>{story}</div><div id="comments-area"><p>{"nice " * 20}</p></div>']
    fitted = main_text.fit(iter([SHELL % f"<article>{STORY}</article>"] * 30))
    for form in forms:
        for weights in (fitted, main_text.Weights()):
            assert main_text.main_text(SHELL % form, weights) == want, form
    assert main_text.main_text("<nav>one two</nav><footer>three four five six</footer>", fitted) == ""
    linked = SHELL % f'<article>{story}<p>See <a href="/item?id=share">the linked words</a></p></article>'
    assert main_text.main_text(linked, fitted) == f"{want}\nSee the linked words"
    deep = "<div class=ad>" * 20_000 + "x" + "</div>" * 20_000 + "<p>" * 20_000
    assert main_text.main_text(deep, fitted) in ("", "x")


def test_main_text_is_the_best_run_of_every_page(spark, small_dir, monkeypatch):
    """Runs and texts against all pairs of ends, on given pages with and without their labels."""
    pages = [r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").limit(20).collect()]
    weights = main_text.fit(iter(pages))
    calls, real = [], main_text.best_run
    monkeypatch.setattr(main_text, "best_run", lambda scores: calls.append(scores) or real(scores))
    for page in [*pages, *(p.replace("article", "div") for p in pages)]:
        seen = main_text.items(page)
        scores = main_text.scores_of(seen, weights)
        low, high = max(((sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))[1:]
        blocks = {}
        for x in seen[-low:-high]:
            if not x.dropped:
                blocks[x.block] = blocks.get(x.block, "") + (" " if x.tag in ("br", "/br") else x.text)
        want = [" ".join(v.split()) for _, v in sorted(blocks.items())]
        assert main_text.main_text(page, weights) == "\n".join(filter(None, want))
    assert len(calls) == 2 * len(pages)


def test_best_run():
    assert main_text.best_run([1, -5, 2, 3, -1, 4, -9, 1]) == (2, 6)
    assert main_text.best_run([-1, -2]) == (0, 0) and main_text.best_run([]) == (0, 0)


def brute(rows, least):
    good = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows)
            if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    unit = {k: v / np.abs(v).max() for k, v in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: [j for j in unit if j != k and unit[j] @ unit[k] >= least] for k in unit}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((i, len(near.get(k, ())), low, i == low))
    return sorted(out)


def test_vector_groups_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16))
    rows = [(k, (centres[r.integers(12)] + 0.12 * r.standard_normal(16)).tolist()) for k in range(500)]
    rows += [(600 + k, rows[3][1]) for k in range(40)] + [(700, [0.0] * 16), (701, [float("nan")] * 16), (702, None),
             (703, [None] + [1.0] * 15), (704, [1e200] * 16), (705, [1e-200] * 16), (706, [])]
    table = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, node int")
    found = vector_dedup.near_duplicates(table.repartition(3), 0.95, leaf_rows=16, spill=0.05, trees=8)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows, 0.95)
    assert vector_dedup.near_duplicates(table.limit(0)).collect() == []


def test_blocks_split_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 20)
    r = np.random.default_rng(5)
    rows = [(k, (np.ones(8) + 0.3 * r.standard_normal(8)).tolist()) for k in range(150)]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows, 0.95)


def test_chains_stay_whole(spark):
    r = np.random.default_rng(8)
    ids = r.permutation(36).tolist()
    rows = [(i, [float(np.cos(k * np.pi / 18)), float(np.sin(k * np.pi / 18)), 0.0]) for k, i in enumerate(ids)][:30]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, leaf_rows=8)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows, 0.95)


def test_recall_of_the_production_forest(spark):
    """Rows whose id is divisible by 50 against all rows, with pairs planted close to the limit and the operator's own parameters."""
    r = np.random.default_rng(12)
    base = r.standard_normal((9000, 24))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    side = r.standard_normal((3000, 24))
    side -= (side * unit[:3000]).sum(1, keepdims=True) * unit[:3000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = r.uniform(0.951, 0.97, (3000, 1))
    rows = np.concatenate((unit, cosine * unit[:3000] + np.sqrt(1 - cosine ** 2) * side))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = np.arange(0, len(rows), 50)
    want = ((rows[asked] @ rows.T) >= 0.95).sum(1) - 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {x.vec_id: x.n_links for x in vector_dedup.near_duplicates(table).where("vec_id % 50 = 0").collect()}
    got = np.array([found[k] for k in asked.tolist()])
    assert want.sum() >= 60 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_forest_grows_with_the_rows():
    r = np.random.default_rng(4)
    unit = r.standard_normal((4000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit[:500] + 0.075 * r.standard_normal((500, 16))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    close = (near * unit[:500]).sum(1) >= 0.95
    for rows in (100_000, 10 ** 7, 10 ** 9):
        forest = vector_dedup.fit_forest(unit, rows, None, vector_dedup.LEAF_ROWS, 17)
        assert rows / 2 ** forest[0].shape[1] <= vector_dedup.LEAF_ROWS and forest[1].shape[1] <= 512
        both = [vector_dedup.leaves_of(v, *forest, vector_dedup.SPILL / 4) for v in (unit[:500], near)]
        met = {k for a, b in zip(*both) for k, _ in set(map(tuple, a.T.tolist())) & set(map(tuple, b.T.tolist()))}
        assert close.sum() > 100 and np.isin(np.flatnonzero(close), sorted(met)).mean() >= 0.95
