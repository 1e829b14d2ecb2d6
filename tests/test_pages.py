import re

import pytest
from hypothesis import given, settings, strategies as st

from tablelens.operators import pages
from tablelens.operators.chunking import chunk_documents, chunk_text

HTML = """<html><head><title> Guide &amp; more </title><style>p{}</style></head><body>
<header>top</header><nav><ul><li><a href="/menu">m</a><li>x</ul></nav><div class="x sidebar"><p>side</div>
<main id="m"><h1>Start</h1><p>First <b>bold</b>
text<p>Second <a href="a/b?x=1#y">link</a></p><ul><li>one<li>two</ul><pre><code>x = 1
y</code></pre><script>if (a < b) {}</script></main><article>later</article>
<a href="http://other.org/z">o</a><a href="/a b">s</a><a href="mailto:q@x">q</a><footer>end</footer></body></html>"""


def test_page():
    title, content, markdown, links = pages.read_page("http://h.org/d/p", HTML)
    assert title == "Guide & more"
    assert content == "StartFirst bold textSecond linkonetwox = 1 y"
    assert markdown.split("\n\n") == ["# Start", "First **bold** text", "Second [link](a/b?x=1#y)", "*   one", "*   two", "```\nx = 1\ny\n```"]
    assert links == ["http://h.org/d/a/b?x=1#y", "http://h.org/a%20b"]
    assert "http://h.org/menu" in pages.read_page("http://h.org/d/p", HTML, keep_navigation=True)[3]


@pytest.mark.parametrize("html,title,content", [
    ("<body><h1>Only</h1> text", "Only", "Only text"),
    ("plain", "u://x", "plain"),
    ("", "u://x", ""),
    ("<nav><nav>in</nav>still</nav><p>out", "u://x", "out"),
    ("<div class='content'>a</div><main>b</main>", "u://x", "a"),
])
def test_page_fallbacks(html, title, content):
    assert pages.read_page("u://x", html)[:2] == (title, content)


def test_references_without_semicolon():
    html = "<title>a &amp; b&&amp</title><p>&lt;x&gt; &copy &ampx; &#65;&#65 &amp;lt; &nope; R&D</p>"
    assert pages.read_page("u://x", html, open_references=False)[:2] == ("a & b&&amp", "<x> &copy &ampx; A&#65 &lt; &nope; R&D")
    assert pages.read_page("u://x", html)[:2] == ("a & b&&", "<x> © &x; AA &lt; &nope; R&D")


def test_pages_are_read_a_few_at_a_time(spark):
    """Slices of a batch give every page once, in order of the batch."""
    rows = [(i, f"http://h/{i}", f"<title>t{i}</title><p>x<a href='/l{i}'>") for i in range(200)] + [(200, "http://h/200", None)]
    assert pages.AT_ONCE < 200
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = pages.extract_pages(df).orderBy("page_id").collect()
    assert [(r["title"], r["links"]) for r in got] == [(f"t{i}", [f"http://h/l{i}"]) for i in range(200)] + [("http://h/200", [])]


def test_link_filter(spark):
    links = ["http://a/x", "http://a/x.PDF", "http://a/login/", "http://a/login", "http://a/?q", "http://a/#t", "http://a/tags/1", "http://a/x.pdf.html"]
    df = spark.createDataFrame([(x,) for x in links], "l string")
    from pyspark.sql import functions as F

    kept = {r["l"] for r in df.where(pages.followable(F.col("l"))).collect()}
    assert kept == {"http://a/x", "http://a/login", "http://a/x.pdf.html"}


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_traversal_takes_the_smallest_depth(spark, depth):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")] + [("b", f"n{i}") for i in range(50)]
    got = {r["node"]: r["depth"] for r in pages.traverse(spark.createDataFrame(edges, "src string, dst string"), "a", depth).collect()}
    full = {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, **{f"n{i}": 2 for i in range(50)}}
    assert got == {k: d for k, d in full.items() if d <= depth}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n", max_size=200), max_size=6), st.integers(20, 80))
def test_chunks_stay_in_bounds_and_lose_nothing(parts, size):
    text = "\n\n".join(parts)
    chunks = chunk_text(text, size, 5)
    assert all(0 < len(c) <= size for c in chunks)
    plain = chunk_text(text, size, 0)
    assert re.sub(r"\s", "", "".join(plain)) == re.sub(r"\s", "", text)


def test_chunks_break_at_sentences_and_overlap():
    text = "x" * 420 + ". " + "y" * 300
    first, second = chunk_text(text)
    assert first == "x" * 420 + "." and second == "y" * 300
    a, b = chunk_text("A" * 300 + " tail end. last words" + "\n\n" + "B" * 300)
    assert a.endswith("last words") and b == "last words\n\n" + "B" * 300


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "p1\n\np2"), (2, ""), (3, None), (4, "z" * 1200)], "doc_id long, text string")
    rows = chunk_documents(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], len(r["content"])) for r in rows] == [(1, 0, 6), (4, 0, 500), (4, 1, 500), (4, 2, 200)]
    assert len({r["chunk_id"] for r in rows}) == 4
