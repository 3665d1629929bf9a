import hashlib

from pyspark.sql import functions as F

from millrace.operators import html_sections as H
from millrace.operators import main_content as M
from millrace.sources import html

LONG = "words that go on for long enough to be counted as a section of the page"
PAGE = f"""<html><head><title>A &amp; B</title><script>var t = "</p><h2>no</h2>";</script></head><body>
<h1>One</h1>intro {LONG}<p>first <a href="/a">a</a> <a href="#b">b</a><img src="i.png" alt="x"></p>
<h2>Two</h2><div>second {LONG}<h3>inner</h3></div><hr><header>kept</header>
<h2>Short</h2><p>few</p>
<h1>Last</h1><p>third {LONG}</p></body></html>"""


def test_tree():
    root = html.parse("<p>a<p>b</p></i></p>c<br>d<img src=x>")
    assert [n.tag for n in root.walk()] == ["p", "p", "br", "img"]
    assert root.text() == "abcd"
    assert html.parse(None).text() == ""
    deep = html.parse("<div>" * 5000 + "x")
    assert deep.text() == "x"


def test_nodes(spark):
    got = html.nodes(spark.createDataFrame([(7, "<ul><li>a</li><li>b<b>c</b></li></ul><p>d</p>")], "page_id long, html string")).orderBy("node_id").collect()
    assert [(r["node_id"], r["parent_id"], r["pos"], r["depth"], r["last_id"], r["tag"], r["text"]) for r in got] == [
        (1, 0, 0, 1, 4, "ul", ""), (2, 1, 0, 2, 2, "li", "a"), (3, 1, 1, 2, 4, "li", "b"), (4, 3, 0, 3, 4, "b", "c"), (5, 0, 1, 1, 5, "p", "d"),
    ]


def test_heading_sections():
    got = H.page_chunks("u", PAGE)
    assert [c["heading"] for c in got] == ["One", "Two", "Last"]
    assert [c["section_index"] for c in got] == [0, 1, 4]
    one, two, _ = got
    assert one["title"] == "A & B"
    assert "second" in one["content"] and "few" in one["content"] and "third" not in one["content"]  # sub-sections are part of it
    assert one["links"] == ["/a"]
    assert one["images"] == [{"src": "i.png", "alt": "x", "title": ""}]
    assert two["content"].startswith("Two\n\nsecond") and "kept" in two["content"] and "few" not in two["content"]
    assert two["chunk_id"] == hashlib.md5(b"u_1_Two").hexdigest()


def test_pages_without_headings():
    page = f"""<title></title><div class="x content"><table><tr><td><a href="/1">One</a><a>Two</a><a href="/e"> </a></td></tr></table>
    <table><tr><td>cell<img src="p.png"></td></tr></table><table></table><p>outside {LONG}</p><span>short</span></div>"""
    nav, media, loose = H.page_chunks("u", page)
    assert nav["content"] == "Navigation - \n\nSections disponibles:\n- One\n- Two" and nav["links"] == ["/1", ""]
    assert nav["chunk_id"] == hashlib.md5(b"u_nav_table_0").hexdigest()
    assert media["heading"] == "Contenu multimédia" and media["content"].endswith("\n\ncell") and len(media["images"]) == 1
    assert loose["heading"] == "Contenu général" and loose["content"] == f"outside {LONG}"
    assert H.page_chunks("u", "") == [] and H.page_chunks("u", None) == []


def test_sections_as_rows(spark):
    df = H.sections(spark.createDataFrame([("u", PAGE), ("v", None), ("w", "<h1>x</h1>")], "url string, html string"))
    assert [r["heading"] for r in df.orderBy("section_index").collect()] == ["One", "Two", "Last"]
    with_text = df.limit(1).select(F.lit("H\n\nt").alias("content"), F.array(F.lit("d1"), F.lit("d2")).alias("descriptions"))
    assert with_text.select(H.media_content(F.col("content"), F.col("descriptions"))).first()[0] == "H\n\nt\n[Image: d1]\n[Image: d2]"


def test_main_content():
    assert M.main_content(f"<nav>n</nav><main>short</main><article>{LONG}</article>") == f"<article>{LONG}</article>"
    assert M.main_content(f"<div>a</div><div id=q>{LONG * 4}</div>").startswith('<div id="q">')
    assert M.main_content("<body><p>x</p><footer>f</footer></body>") == "<body><p>x</p></body>"
    assert M.main_content("<p>x</p>") == "<p>x</p>" and M.main_content(None) == ""
    assert M.main_content("<p>x</p>", lambda h: ("T", "y" * 50)) == "<h1>T</h1>\n" + "y" * 50
    assert M.main_content("<p>x</p>", lambda h: ("T", "y")) == "<p>x</p>"


def test_markdown():
    page = '<h2>T</h2><p>a <b>bold</b> <em>it</em> <a href="/x">l</a> <img src="i.png" alt="p"></p><ul><li>one<li>two</ul><ol><li>n</li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>x\n  y</pre><blockquote>q</blockquote>c &lt; d'
    got = M.html_to_markdown(page)
    for part in ("## T", "a **bold** _it_ [l](/x) ![p](i.png)", "* one", "1. n", "a | b\n---|---\n1 | 2", "```\nx\n  y\n```", "> q", "c < d"):
        assert part in got
    assert M.html_to_markdown("") == "" and M.html_to_markdown(None) == ""


CUT = '<title>token = &quot</title><article><h1>a token = &quot</h1><p>&lt b &amp c &quot;d&quot; &eacute; &#233; %s</p></article>' % LONG


def test_main_content_keeps_references_that_were_cut_off():
    assert M.main_content(CUT) == f'<article><h1>a token = &amp;quot</h1><p>&amp;lt b &amp; c "d" é é {LONG}</p></article>'


def test_markdown_keeps_references_that_were_cut_off():
    assert M.html_to_markdown(M.main_content(CUT)) == f'# a token = &quot\n\n&lt b & c "d" é é {LONG}\n'


def test_sections_keep_references_that_were_cut_off():
    (got,) = H.page_chunks("u", CUT)
    assert (got["title"], got["heading"], got["content"]) == ("token = &quot", "a token = &quot", f'a token = &quot\n\n&lt b & c "d" é é {LONG}')


def test_titles_keep_references_that_were_cut_off():
    assert H.page_title(html.parse(CUT)) == "token = &quot"
