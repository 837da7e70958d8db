import html
import re

import numpy as np

from placebook.llm._markup import blocks_of
from placebook.llm.html_text import Labeller, _padded, extracted, fit, main_texts, op9_html_text, vectors


def truth(page):
    """The article of the tables' own pages, read by their known layout."""
    body = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
    parts = (html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.split(r"</?(?:article|h1|h2|p|ul|li|div)[^>]*>", body))
    return "\n\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title></head><body><header class="siteTop">Head</header><script>var t="</p>";</script>
      <p>One &amp; <b>t&#119;o</b><br>three<!-- <p>gone</p> --><p>a &lt; b  <a href="x>y">link</a> 1 < 2<ul><li>x<li>y</ul><style>p{}</style><svg/>tail &unknown; </body>"""
    got = [(b.path[-1], b.text, b.link_chars) for b in blocks_of(page)]
    assert got == [(".top", "Head", 0), ("p", "One & two three", 0), ("p", "a < b link 1 < 2", 4), ("li", "x", 0), ("li", "y", 0), ("body", "tail &unknown;", 0)]
    assert blocks_of("") == [] and blocks_of("plain") and blocks_of("<div") and blocks_of("<p>" * 3000 + "x" + "<" * 3000)


def test_open_tags_of_any_depth_and_left_out_end_tags():
    deep = "<article>" + "<div class=x>" * 5000 + "in" + "</div>" * 5000 + "out</article><p>after"
    inside, outside, after = blocks_of(deep)
    assert inside.path == ("article", "div", ".x") and outside.path == ("article",) and after.path == ("p",)
    rows = blocks_of("<main><table>" + "<tr><td>a<td>b" * 3000 + "</table>x<ul>" + "<li><p>c" * 3000 + "<ul><li>d<li>e</ul></ul>y</main>z")
    assert {b.path for b in rows if b.text in "ab"} == {("main", "table", "tr", "td")} and {b.path for b in rows if b.text == "c"} == {("main", "ul", "li", "p")}
    assert {b.path for b in rows if b.text in "xy"} == {("main",)} and rows[-1].path == ()
    assert {b.path for b in rows if b.text in "de"} == {("main", "ul", "li")}


def test_long_pages_are_read_in_runs(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    labeller = fit(table)
    pages = [r.html for r in table.limit(12).collect()]
    page = "".join(pages)
    assert np.allclose(labeller.score_long(blocks_of(page), 7), labeller.score(*_padded([vectors([blocks_of(page)])])[:2])[:, 0], atol=1e-4)
    assert list(main_texts(pages, labeller)) == list(main_texts(pages, labeller, most_cells=5))


def test_pages_and_layouts_that_fit_has_not_seen(spark, sf):
    """Fitted on one table, read on other pages, as they are and with their tags and class words changed."""
    labeller = fit(spark.read.parquet(f"{sf}/pages.parquet"))
    seen = {r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html and r.html not in seen]
    want = [truth(p) for p in pages]
    assert len(pages) >= 100
    for change, least in ((lambda p: p, 0.98), (lambda p: re.sub(r"(</?)article", r"\1div", p), 0.95), (lambda p: re.sub(r' (?:class|id|role)="[^"]*"', "", p), 0.9)):
        got = list(main_texts([change(p) for p in pages], labeller))
        good = sum(a == b for a, b in zip(got, want)) / len(pages)
        print("held-out pages right:", good)
        assert good >= least


def test_gradients():
    rng = np.random.default_rng(0)
    labeller = Labeller.fresh(1)
    pages = [rng.normal(size=(n, labeller.w[0].shape[0])).astype(np.float32) for n in (1, 4, 6)]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]
    x, mask, y = _padded(pages, labels)

    def loss():
        z = labeller.score(x, mask).astype(np.float64)
        return (np.log1p(np.exp(-np.where(y > 0, z, -z))) * mask).sum() / mask.sum()

    for v, g in zip(labeller.values(), labeller.gradients(x, mask, y)):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old = v[at]
            v[at] = old + 0.02
            up = loss()
            v[at] = old - 0.02
            down = loss()
            v[at] = old
            assert abs((up - down) / 0.04 - g[at]) < 2e-3


def test_query_on_the_tables_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_html_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == truth(pages[r.page_id]) for r in rows) >= 0.99 * len(rows)


def test_other_layouts_and_edge_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    labeller = fit(table)
    prose = truth(table.first().html).split("\n\n")
    long = max(prose, key=len)
    page = f"""<html><body><div class="cookie-banner">We use cookies on this site.</div><header><h1>Daily</h1></header>
      <div class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></div>
      <article class="post"><h1>{html.escape(prose[0])}</h1><p>{html.escape(long)}</p><p>{html.escape(long)}</p></article>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href="/b">Other news</a></li></ul></aside>
      <section class="comments"><h2>Comments</h2><div class="comment"><p>Nice one, thanks.</p></div></section>
      <form class="newsletter"><p>Sign up</p><button>Go</button></form><footer><p>&copy; 2024</p></footer></body></html>"""
    assert list(main_texts([page], labeller)) == ["\n\n".join([prose[0], long, long])]
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>"), (3, "u", page), (3, "u", page)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = sorted((r.page_id or 0, r.n_chars) for r in extracted(odd, labeller).collect())
    assert [k for k, _ in got] == [0, 1, 2, 3, 3] and [n > 0 for _, n in got] == [False, False, False, True, True]
    assert extracted(odd.limit(0), fit(odd.limit(0))).count() == 0
    assert vectors([]).shape[0] == 0


def plain_scores(labeller, blocks):
    """The network block by block and cell by cell, as its definition says."""
    x, hidden = vectors([blocks]).astype(np.float64), labeller.u[0].shape[0]
    total = np.full(len(blocks), float(labeller.bias[0]))
    for way in (0, 1):
        w, u, b = (v[way].astype(np.float64) for v in (labeller.w, labeller.u, labeller.b))
        h, c = np.zeros(hidden), np.zeros(hidden)
        for t in range(len(blocks)) if way == 0 else reversed(range(len(blocks))):
            z = x[t] @ w + h @ u + b
            for k in range(hidden):
                i, f, o = (1 / (1 + np.exp(-z[gate * hidden + k])) for gate in range(3))
                c[k] = f * c[k] + i * np.tanh(z[3 * hidden + k])
                h[k] = o * np.tanh(c[k])
            total[t] += h @ labeller.out[way * hidden : (way + 1) * hidden]
    return total


def test_query_against_brute_force(spark, sf):
    """Every page of the table: the texts of the blocks that a plain block-by-block network takes."""
    table = spark.read.parquet(f"{sf}/pages.parquet")
    labeller = fit(table)
    got = {r.page_id: (r.text, r.n_chars) for r in extracted(table, labeller).collect()}
    pages = table.collect()
    assert len(got) == len(pages)
    for r in pages:
        blocks = blocks_of(r.html or "")
        scores = plain_scores(labeller, blocks) if blocks else []
        want = "\n\n".join(b.text for b, s in zip(blocks, scores) if s > 0)
        assert got[r.page_id] == (want, len(want)) or any(abs(s) < 1e-4 for s in scores)
    assert {r.page_id: r.text for r in op9_html_text(spark, sf).collect()} == {k: t for k, (t, _) in got.items()}
