import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.llm import html_extract as H

ARTICLE = "A sentence of the article, long enough to look like one, with some commas and words in it."


def page(body, tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{body}<footer>&copy; x</footer>{tail}'


PAGES = {
    1: (page(f"<article><h1>Title &amp;\n more</h1><p><b>{ARTICLE}<br><p>Short.</p><div class='ad'>Buy &lt;now&gt;!</div><p>{ARTICLE}</p></article>"), f"Title & more\n\n{ARTICLE}\n\nShort.\n\n{ARTICLE}"),
    2: (page(f"<main><p>{ARTICLE}</p><form><label>Mail</label><input><button>Go</button></form></main><aside>See also</aside><div id=comments><p>{ARTICLE}</p></div>"), ARTICLE),
    3: (page(f"<!-- <p>hidden</p> --><article><p>{ARTICLE}</p>", ""), ARTICLE),
    4: (None, ""),
    5: ("", ""),
    6: ("<nav>Menu", ""),
    7: ("<<<>>><p", None),
    8: (page(f"<div class='layout with-sidebar'><article><h1 class='entry-header'>Title</h1><p>{ARTICLE}</p></article><div class='sidebar'><p>{ARTICLE}</p></div></div>"), f"Title\n\n{ARTICLE}"),
    9: (page(f"<form action=x><div><p>{ARTICLE}</p><p>{ARTICLE}</p><p>{ARTICLE}</p></div></form>"), "\n\n".join([ARTICLE] * 3)),
    10: (page(f"<form><article><p>{ARTICLE}</p><noscript>Seen without scripts.</noscript><p>Of <math><mi>x</mi></math> and <svg><text>y</text></svg>.</p></article><select><option>1</option></select></form>"), f"{ARTICLE}\n\nSeen without scripts.\n\nOf x and y."),
    11: (page(f"<main><article><header><h1>Title</h1><p>By someone</p></header><p>{ARTICLE}</p><aside><p>{ARTICLE}</p></aside><footer>Tags</footer></article><section id='comments'><h2>Comments</h2><article class='c'><p>no landmark of its own kind</p></article></section></main>").replace("<article class='c'>", "<div class='reply'>").replace("</article></section>", "</div></section>"), f"Title\n\nBy someone\n\n{ARTICLE}"),
    12: (page(f"<div class='notice'><p>{ARTICLE}</p></div><div class='content'><p>{ARTICLE}</p><p>Yes.</p></div><div class='cookie-consent'>{ARTICLE}</div>"), f"{ARTICLE}\n\nYes."),
    13: (page(f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p><p>Ok</p><p>{ARTICLE}</p></div>"), "\n\n".join([ARTICLE, ARTICLE, "Ok", ARTICLE])),
    14: (page(f"<article><p title='a > b'>{ARTICLE}</p><p title=\"never closed>{ARTICLE}</p></article>"), f"{ARTICLE}\n\n{ARTICLE}"),
    15: (page("<article>" + f"<p>{ARTICLE}</p>" * 12_000 + "</article>"), "\n\n".join([ARTICLE] * 12_000)),
}


def test_pages(spark):
    df = spark.createDataFrame([(i, "http://x", p, 1) for i, (p, _) in PAGES.items()] + [(None, None, PAGES[1][0], 1), (1, "http://x", PAGES[1][0], 1)], "page_id long, url string, html string, text int").withColumn("k", F.lit("x"))
    got = H.extract_main_text(df).collect()
    assert len(got) == len(PAGES) + 2
    for r in got:
        want = PAGES[r.page_id or 1][1]
        assert r.n_chars == len(r.text)
        assert want is None or r.text == want, r.page_id


def test_empty_table(spark):
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_cut_is_minimal(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 9))
    z = r.normal(0, 2, n)
    edges = [(i, j, int(r.integers(0, 150))) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
    cap = np.rint(np.clip(z, -12, 12) * 100).astype(int)

    def cost(keep):
        return sum(c for c, k in zip(cap, keep) if c > 0 and not k) + sum(-c for c, k in zip(cap, keep) if c < 0 and k) + sum(w for i, j, w in edges if keep[i] != keep[j])

    assert cost(H.max_flow_content(z, edges)) == min(cost(k) for k in itertools.product((False, True), repeat=n))


def fitted(pages):
    taught = [H.lessons(p) for p in pages]
    return H.fit_model(np.concatenate([x for x, *_ in taught]), np.concatenate([y for _, y, _ in taught]), sum(p for *_, p in taught))


def test_cut_mends_what_blocks_alone_get_wrong(spark):
    """On given pages, with their landmarks and with them hidden: the cut changes labels, and for the better."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    model = fitted(pages[:500])
    n = own_right = right = hidden_right = changed = 0
    for p in pages[500:]:
        blocks, kinds, outer = H.blocks_of(p)
        y = np.array([kinds[m] > 0 for m in H.landmarks(blocks, kinds, outer)])
        _, own, keep = H.label_blocks(p, model)
        hidden = H.label_blocks(p, model, hidden=True)[2]
        n, changed = n + len(y), changed + int(((own > 0) != keep).sum())
        own_right, right, hidden_right = own_right + int(((own > 0) == y).sum()), right + int((keep == y).sum()), hidden_right + int((hidden == y).sum())
    assert right == n and changed > 0 and own_right < n and hidden_right >= own_right and hidden_right > 0.99 * n


@pytest.mark.parametrize("n", [1, 5, 6, 8, 40, 200])
def test_what_a_landmark_says_does_not_depend_on_how_much_it_holds(spark, n):
    """Links and tables of any length stay in their article, comments and footers of any length stay out."""
    model = fitted([r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").limit(300).collect()])
    links = "".join(f"<li><a href='/x{i}'>Link number {i}</a></li>" for i in range(n))
    table = "".join(f"<tr><td>{i}</td><td>cell</td></tr>" for i in range(n))
    prose = "".join(f"<p>I liked this long article about many things, and I thank you for it, number {i}.</p>" for i in range(n))
    article, nav = f"<h1>Title of it</h1><p>{ARTICLE}</p><p>{ARTICLE}</p>", "<nav><a href='/'>Home</a></nav>"
    for body, want in (
        (f"{nav}<article>{article}<ul>{links}</ul></article>", 3 + n),
        (f"{nav}<article>{article}<table>{table}</table></article>", 3 + 2 * n),
        (f"{nav}<article>{article}</article><div class='comments'>{prose}</div>", 3),
        (f"{nav}<article>{article}<div class='comments'>{prose}</div></article>", 3),
        (f"{nav}<article>{article}</article><footer>{prose}</footer>", 3),
        (f"<div class='sidebar'>{prose}</div><div class='content'>{article}<ul>{links}</ul></div>", 3 + n),
    ):
        assert H.label_blocks(body, model)[2].sum() == want


@pytest.mark.parametrize("markup", ['<a title="x">', '<a "', "<b>", "<p><i>", "<div></b>", "<nav>x", "<article><p>word, and more.", "<!--", "<script>", "<a title='x>", "<", "&amp;", '"> <a \'', "<td>x"])
def test_time_grows_with_length(markup):
    model = np.array([*H.PRIOR.values(), *H.TIES.values()])
    took = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        H.main_text(markup * n + "</b>" * n, model)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_blocks_against_a_tree():
    """Nested elements made at random: every text lies in the block of its nearest block element, under the nearest landmark."""
    import random

    for seed in range(40):
        r, n, want, out = random.Random(seed), 0, [], []

        def grow(depth, mark):
            nonlocal n
            tag = r.choice(["div", "section", "article", "nav", "aside", "blockquote"])
            own = {"article": 1, "nav": -1, "aside": -1}.get(tag, mark)
            out.append(f"<{tag}>")
            for _ in range(r.randint(1, 3)):
                if depth < 5 and r.random() < 0.6:
                    grow(depth + 1, own)
                else:
                    n += 1
                    out.append(f"<p>text <i>{n}</i></p>")
                    want.append((f"text {n}", own))
            out.append(f"</{tag}>")

        grow(0, 0)
        blocks, kinds, _ = H.blocks_of("".join(out))
        assert [(b.text, kinds[b.mark]) for b in blocks] == want
