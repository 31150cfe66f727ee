"""Pages as blocks: each rule on a page of its own."""

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from worldstate.sources import html_tree, page_blocks


def blocks(html):
    return [(b["t"], b["k"]) for b in page_blocks.extract(html)["blocks"]]


def texts(html):
    return [t for t, _ in blocks(html)]


LONG = " ".join(f"word{i}" for i in range(80))


def test_headers_stay_for_their_copy():
    page = """<header class=top><a href=/>Logo</a> <a href=/a>Products</a></header>
      <header><nav><a href=/x>Docs</a></nav><h1>Payments at just 2%</h1><p>No fees for any new business on it.</p></header>
      <header>Small</header><main><p>Body copy.</p></main>"""
    assert texts(page) == ["Payments at just 2%", "No fees for any new business on it.", "Body copy."]


def test_menus_go_where_they_are_links():
    page = """<ul class=main-menu><li><a href=/1>Pricing</a><li><a href=/2>Careers</a></ul>
      <div class=menu-item><h3>Paneer Tikka</h3><span>₹299</span></div><div aria-label="Lunch menu">Dal</div>"""
    assert texts(page) == ["Paneer Tikka", "₹299", "Dal"]


def test_a_wrapper_with_a_banners_name_stays():
    assert texts(f'<body><div class="nav-open"><h1>Pricing 2%</h1><p>{LONG}</p></div><div class="cookie-bar">Accept</div></body>') == ["Pricing 2%", LONG]
    assert texts('<div class="nav-open"><h1>Pricing 2%</h1></div>') == []


@pytest.mark.parametrize(
    "markup",
    [
        '<div role="navigation">x</div>', '<div aria-modal="true">x</div>', '<div id="onetrust-banner">x</div>', '<p class="breadcrumbs">x</p>', '<div class="site-footer">x</div>',
        '<div class="modal-body">x</div>', '<div class="skip_link">x</div>', '<a href="#c">Skip to content</a>', '<div aria-label="Cookie notice">x</div>', "<nav>x</nav>", "<aside>x</aside>",
        "<form><button>x</button><select><option>x</select></form>", "<svg><title>x</title></svg>", "<noscript>x</noscript>", "<script>x</script>", "<div class=subscribe-box>x</div>", "<div class=top_nav>x</div>",
    ],
)
def test_boilerplate(markup):
    assert texts(f"<p>Before</p>{markup}<p>After</p>") == ["Before", "After"]


@pytest.mark.parametrize("markup", ['<div class="trusted-by">x</div>', '<div class="cmp-text">x</div>', '<div class="navy">x</div>', '<main class="modal">x</main>', '<div class="skipper">x</div>', '<div class="footnotes">x</div>'])
def test_names_that_only_look_alike(markup):
    assert texts(f"<p>Before</p>{markup}<p>After</p>") == ["Before", "x", "After"]


@pytest.mark.parametrize(
    ("markup", "line"),
    [
        ("<span>Starting at</span><span>₹2,499</span>", "Starting at ₹2,499"), ("<span>₹</span><span>2499</span><span>/mo</span>", "₹2499/mo"), ("<span>2</span><span>.5%</span>", "2.5%"),
        ("Fast.<b>Secure</b>", "Fast. Secure"), ("<b>0%</b>*", "0%*"), ("<b>1,</b><b>000</b>", "1,000"), ("<i>a</i><i>(b)</i>", "a (b)"), ("one<br>two", "one two"), ("a<b></b><b> c</b>", "a c"), ("x​y z", "xy z"),
    ],
)
def test_inline_edges(markup, line):
    assert texts(f"<div>{markup}</div>") == [line]


def test_kinds_in_order():
    page = "<h2>Plan</h2>loose <b>text</b><p>Para</p>tail<ul><li>Cards<ul><li>Visa<li>RuPay</ul></li><li>UPI</ul><dl><dt>T<dd>D</dl><table><caption>C</caption><tr><th>Way<th>Fee<tr><td>UPI<td><div>0%</div></table>"
    want = [("Plan", "heading"), ("loose text", "other"), ("Para", "paragraph"), ("tail", "other"), ("Cards", "list_item"), ("Visa", "list_item"), ("RuPay", "list_item"), ("UPI", "list_item"), ("T", "paragraph"), ("D", "paragraph"), ("C", "paragraph"), ("Way | Fee", "table_row"), ("UPI | 0%", "table_row")]
    assert blocks(page) == want


def test_tables():
    nested = "<table><tr><td><h2>Plans</h2><table><tr><td>Basic</td><td>2%</td></tr></table></td></tr></table>"
    assert texts(nested) == ["Plans", "Basic | 2%"]
    assert texts(f"<table><tr><td>{LONG} {LONG} {LONG}</td><td>end</td></tr></table>") == [f"{LONG} {LONG} {LONG}", "end"]
    icons = '<tr><td>Instant</td><td><svg aria-label="Not included"></svg></td><td><img alt="Included"></td><td><svg><title>Soon</title></svg></td><td></td></tr>'
    assert texts(f"<table>{icons}</table><img alt=none>") == ["Instant | Not included | Included | Soon"]


def test_separators_and_repetitions():
    assert texts("<p>Banking</p><p>|</p><p>Payroll</p><p>•</p><div>*</div>") == ["Banking", "Payroll", "*"]
    assert texts("<div>Free</div><div>Free</div><p>x</p><div>Free</div>") == ["Free", "x", "Free"]


def test_metadata():
    page = """<html lang="en-IN"><head><title> Pricing |\n Pay </title><meta name="Description" content="Clear."><link rel="x canonical" href="/pricing/">
      <meta property="article:published_time" content="nonsense"><meta itemprop="datePublished" content="2026-09-21T10:15:00+05:30"></head><body><svg><title>no</title></svg>x"""
    found = page_blocks.extract(page, "https://pay.example/a")
    assert {k: v for k, v in found.items() if k != "blocks"} == {"title": "Pricing | Pay", "description": "Clear.", "canonical_url": "https://pay.example/pricing/", "lang": "en-IN", "published_at": "2026-09-21T04:45:00Z"}
    assert page_blocks.extract('<meta property="og:title" content="T"><p>x')["title"] == "T"
    assert page_blocks.extract("<p>x")["title"] is None


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<!--", "<!-- <p>x", "</p></div>", "<script>"])
def test_no_page_is_an_error(html):
    assert blocks(html) == []


def test_omitted_and_stray_tags():
    assert blocks("<p>a<p>b</div>c<div>d</p>e") == [("a", "paragraph"), ("bc", "paragraph"), ("de", "other")]
    assert texts("<table><tr><td>a</p></div>b<td>c</table>d") == ["ab | c", "d"]
    assert texts("<head><title>t</title><p>a</p></head><p>b") == ["a", "b"]
    tree = html_tree.read("<ul><li>a<li>b</ul>c")
    assert tree.text_of(0) == "ab" and [tree.text_of(x) for x in tree.within(0)] == ["a", "b"]


def test_in_spark(spark):
    rows = [(1, "<p>a</p><p>b c</p>"), (2, None), (3, "<p>" + "x " * 50000), (1, "<p>a</p><p>b c</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).repartition(20)
    found = page_blocks.with_page(df).select("page_id", page_blocks.page_text(F.col("page")).alias("text"), page_blocks.words(F.col("page")).alias("n"))
    assert sorted((r.page_id, len(r.text), r.n) for r in found.collect()) == [(1, 5, 3), (1, 5, 3), (2, 0, 0), (3, 99999, 50000)]
    assert page_blocks.with_page(df.limit(0)).count() == 0


def test_references_count_with_a_semicolon():
    page = "<html><head><title>R&amp;D &amp</title><link rel=canonical href='/x?a=1&copy=2&amp;b=3'></head><body><h1>A &amp; B &#38 C &lt;p&gt; &nosuch; &notit; D &amp</h1><script>a&b</script></body></html>"
    assert texts(page) == ["A & B & C <p> &nosuch; &notit; D &amp"]
    found = page_blocks.extract(page, "https://example.com/")
    assert (found["title"], found["canonical_url"]) == ("R&D &amp", "https://example.com/x?a=1&copy=2&b=3")


def test_batches_give_a_page_a_row(spark):
    """More pages than are Python's objects at a time, among them null ones; pages don't pass through pandas."""
    rows = [(i, None if i % 7 == 0 else f"<head><title>t{i}</title></head><p>Text {i}</p>", None) for i in range(250)]
    df = page_blocks.with_page(spark.createDataFrame(rows, "i int, html string, url string").repartition(1))
    assert page_blocks.page.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    found = {r.i: r.page for r in df.collect()}
    assert len(found) == 250 and all((p.title, [tuple(b) for b in p.blocks]) == ((None, []) if i % 7 == 0 else (f"t{i}", [(f"Text {i}", "paragraph")])) for i, p in found.items())
