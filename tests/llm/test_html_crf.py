import html
import itertools
import re

import numpy as np

from verdigrain.llm import html_crf, queries

TRICKY = [
    None, "", "plain words only", "<p>", "<article><h1>A</h1><p>One &amp; two&nbsp;three<br>four</p></article>", "<script>if (a < b) document.write('<p>x</p>')</script>",
    "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><p>It is a long sentence, and it says something.<p>Another one that isn't closed.</article><footer>&copy; me</footer>",
    "<!-- <p>no</p> --><article><p>" + "long text. " * 50_000 + "</p></article>", "<div class=x id='y z'>a<![CDATA[b]]></div", "</p></div><<>>&#x41;&#65;&bogus;",
]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in queries.op9_html_crf(spark, sf_dir).collect()}
    wrong = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        own = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split("</?(?:p|h1)>", own)]
        found = rows[r.page_id]
        wrong += found.text != "\n\n".join(filter(None, blocks))
        assert found.url == r.url and found.n_chars == len(found.text)
    assert wrong <= 0.01 * len(rows)


def test_awkward(spark):
    rows = [(i, None, t, "clash", "clash") for i, t in enumerate(TRICKY)] + [(None, "u", TRICKY[4], "c", "c")] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    found = html_crf.extract(table).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r.text for r in found if r.page_id is not None}
    assert by_id[0] == by_id[1] == by_id[3] == by_id[5] == ""
    assert by_id[4] == "A\n\nOne & two three four"
    assert by_id[6] == "It is a long sentence, and it says something.\n\nAnother one that isn't closed."
    assert by_id[7] == ("long text. " * 50_000).strip()
    assert html_crf.extract(table.where("false")).count() == 0


def test_blocks():
    found = html_crf.blocks_of("<div>a <b>b</b><p>c<ul><li>d<li>e <a href=x>f</a></ul>g</div>h<textarea><p>i</textarea><style>p{}</style>")
    assert [b.text for b in found] == ["a b", "c", "d", "e f", "g", "h"]
    assert found[2].path == ("div", "ul", "li") and found[4].path == ("div",) and found[3].linked == 1


def test_chain_against_enumeration():
    draw = np.random.default_rng(4)
    weights, moves = draw.normal(size=(html_crf.SIZE, 2)), draw.normal(size=(2, 2))
    chain = html_crf.Chain(weights, moves)
    for n in (1, 2, 5, 7):
        rows = [draw.integers(0, html_crf.SIZE, 3).tolist() for _ in range(n)]
        scores = np.array([weights[r].sum(0) for r in rows])
        paths = list(itertools.product((0, 1), repeat=n))
        value = np.array([sum(scores[t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        assert tuple(chain.decoded(rows)) == paths[int(value.argmax())]
        share = np.exp(value - np.logaddexp.reduce(value))
        padded = np.zeros((1, 9, 2))
        padded[0, :n] = scores
        alive = np.arange(9)[None] < n
        unary, pair = html_crf.Chain._marginals(padded, moves, alive)
        for t in range(n):
            assert np.isclose(unary[0, t, 1], sum(s for s, p in zip(share, paths, strict=True) if p[t]))
        assert np.isclose(pair.sum(), n - 1)


def test_held_out_layouts():
    chain, right, total = html_crf.default_chain(), 0, 0
    for blocks, labels in html_crf.labelled_pages.__wrapped__(100, 99):
        found = chain.decoded(html_crf.features_of(list(blocks)))
        right, total = right + sum(a == b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert right > 0.97 * total


def test_layouts_without_telling_elements():
    chain, counts = html_crf.default_chain(), np.zeros((2, 2), int)
    for blocks, labels in html_crf.labelled_pages.__wrapped__(200, 99, 1):
        for a, b in zip(chain.decoded(html_crf.features_of(list(blocks))), labels, strict=True):
            counts[a, b] += 1
    precision, recall = counts[1, 1] / counts[1].sum(), counts[1, 1] / counts[:, 1].sum()
    assert precision > 0.9 and recall > 0.9, (precision, recall)


def test_same_labels_as_from_listed_features():
    chain = html_crf.default_chain()
    pages = [t for t in TRICKY if t] + ["<div class='a b'>x<div class=a>y<p>z</div>t</div><p class=b>" * 5, "<i><div>a</i>b</div>c<a href=x><p>d</a>e</p>", "<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f"]
    for page in pages:
        blocks = html_crf.blocks_of(page)
        assert chain.labelled(blocks) == chain.decoded(html_crf.features_of(blocks))


def test_broken_markup():
    texts = lambda page: [b.text for b in html_crf.blocks_of(page)]
    assert texts("a <b c <d") == ["a <b c <d"]
    assert texts('<p title="x>y">a</p><p title="open>b') == ["a", "b"]
    assert texts("x<!-- never ends <p>y") == ["x"] and texts("x <y <!-- z") == ["x <y"]
    assert texts("<script>a</script b>c<script>d") == ["c"]
    assert texts("<tr><td>a<tr><td>b<tr><th>c") == ["a", "b", "c"] and len(html_crf.blocks_of("<tr><td>a" * 50)[-1].path) == 2
    assert texts("&#" + "9" * 5000 + ";&#x" + "0" * 6000 + "41; &#0000065;") == ["�A A"]


def test_time_grows_with_the_page():
    import time

    chain = html_crf.default_chain()
    kinds = {
        "open": lambda n: "<a " * (n // 3), "deep": lambda n: "<div>x" * (n // 6), "stray": lambda n: "<div>" * (n // 18) + "x</i>" * (n // 9), "names": lambda n: "".join(f"<div class=c{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}>x" for k in range(n // 16)),
        "quotes": lambda n: "<a ''" * (n // 5) + "<a '", "scripts": lambda n: "<script>" + "</script " * (n // 9), "rows": lambda n: "<tr><td>x" * (n // 9), "crossed": lambda n: "<i><p>x</i>" * (n // 11),
    }
    def took(page):
        start = time.process_time()
        html_crf.text_of(page, chain)
        return time.process_time() - start

    for name, make in kinds.items():
        short, long = (min(took(make(size)) for _ in range(2)) for size in (1 << 17, 1 << 19))
        assert long < 2.3**2 * max(short, 0.1), (name, short, long)
    for name in ("open", "deep", "stray"):
        assert took(kinds[name](1 << 22)) < 30
