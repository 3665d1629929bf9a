import time

import numpy as np
import pytest

from millrace.llm import dom, extract


@pytest.fixture(scope="module")
def model():
    return extract.train()


def test_blocks():
    got = [b.text for b in dom.blocks("<body><p>a <b>b</b>&nbsp;c<br>d<p>e &lt;x&gt;</p><script>no</script>f<!-- no --><div>g</div> </body>")]
    assert got == ["a b c d", "e <x>", "f", "g"]
    assert dom.blocks("") == [] and [b.text for b in dom.blocks("just text")] == ["just text"]
    assert len(dom.blocks("<div>" * 3000 + "x")) == 1


def test_optional_and_missing_tags():
    show = lambda h: [b.text for b in dom.blocks(h)]
    assert show("<html><head><meta charset=x><title>t</title><style>no</style><p>one<p>two") == ["one", "two"]
    assert show("<head><title>t</title>text") == ["text"]
    assert show("<head><title>t</title></head><body>a<svg><g></svg>b<video>c<p>d") == ["a", "b", "c", "d"]
    assert show("a<script>if (x < 1) {}") == ["a"]
    linked = dom.blocks("<p>x <a href='/'>link</a> y <b>z</b></p><p>plain</p>")
    assert [(b.linked, b.bold) for b in linked] == [(4, True), (0, False)]


@pytest.mark.parametrize(
    "page",
    ["<div>" * 32_000 + "<p></div></p></x></y>" * 32_000, "<b>x" * 32_000 + "</u>" * 32_000, "<a><div>" + "<b>" * 30_000 + "</a>" * 30_000, "<div>" * 16_000 + "<li>x" * 16_000, "<svg>" * 20_000 + "x"],
)
def test_work_follows_the_length_of_a_page(page):
    began = time.perf_counter()
    dom.blocks(page)
    assert time.perf_counter() - began < 20


def test_pages_made_from_another_seed(model):
    right = total = 0
    for blocks, labels in extract.labelled_pages(200, seed=99):
        scores = [sum(model["w"].get(f, 0.0) for f in (*b.above.features, *extract.features(b))) for b in blocks]
        if scores:
            scores[0] += model["first"]
        got = extract.viterbi(scores, model["pair"])
        right += sum(g == y for g, y in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 8))
        s, pair = r.normal(size=n).tolist(), r.normal(size=(2, 2)).tolist()
        value = lambda y: sum(a for a, b in zip(s, y, strict=True) if b) + sum(pair[a][b] for a, b in zip(y, y[1:], strict=False))
        every = [[i >> k & 1 for k in range(n)] for i in range(2**n)]
        assert value(extract.viterbi(s, pair)) == pytest.approx(max(map(value, every)))
    assert extract.viterbi([], [[0, 0], [0, 0]]) == []


def test_marginals_are_sums_over_all():
    r = np.random.default_rng(4)
    crf = extract.Crf()
    crf.pair = r.normal(size=(2, 2))
    e = r.normal(size=5)
    every = np.array([[i >> k & 1 for k in range(5)] for i in range(32)])
    weight = np.exp([(e * y).sum() + sum(crf.pair[a, b] for a, b in zip(y, y[1:], strict=False)) for y in every])
    p, pairs = crf._marginals(e)
    assert np.allclose(p, (weight[:, None] * every).sum(0) / weight.sum())
    assert np.isclose(pairs[1, 0], sum(w * sum((a, b) == (1, 0) for a, b in zip(y, y[1:], strict=False)) for w, y in zip(weight, every, strict=True)) / weight.sum())


def test_an_article_without_its_surroundings(model):
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="ad">Buy now something cheap.</div><article><h1>The title &amp; more</h1><p>The first paragraph has a number of words in it,
    and goes on.</p><p>The second one is &lt;also&gt; here.</p></article><form><label>Mail</label><input><button>Subscribe</button></form>
    <aside><h3>Related</h3><p>Other things to read.</p></aside><footer>&copy; h &middot; All rights reserved.</footer></body></html>"""
    assert extract.main_text(page, model) == "The title & more\nThe first paragraph has a number of words in it, and goes on.\nThe second one is <also> here."


def test_tables_of_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (3, "u", "<p>"), (None, "u", "<article><h1>A title</h1><p>Some words that make a sentence, and then some more of them.</p></article>")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = extract.extract(df).collect()
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"]] == [""] * 4
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.extract(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "u", "<article>" + "<p>Words in a sentence that is not short.</p>" * 20_000 + "</article>")], "page_id long, url string, html string")
    assert extract.extract(huge).first()["n_blocks"] == 20_000
