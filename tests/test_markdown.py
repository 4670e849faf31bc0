"""HTML to Markdown (P18): golden pages, properties over all pages, linear time."""

import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from coheral.functions.markdown import convert
from coheral.operators import conversations as C
from tests.conftest import SMALL

GOLDEN = {
    # lists
    "<ul><li>one</li><li>two</li></ul>": "* one\n* two",
    "<ol><li>a</li><li>b</li></ol>": "1. a\n2. b",
    "<ol start='7'><li>a<li>b</ol>": "7. a\n8. b",
    "<ul><li>a<ul><li>b<ol><li>c</li><li>d</li></ol></li></ul></li><li>e</li></ul>": "* a\n    + b\n        1. c\n        2. d\n* e",
    "<ul><li><p>p1</p><p>p2</p></li><li>q</li></ul>": "* p1\n\n    p2\n\n* q",
    "<p>before</p><ul><li>x</li></ul>after": "before\n\n* x\n\nafter",
    "<li>alone": "* alone",
    # tables
    "<table><tr><td>1</td><td>2</td></tr></table>": "| 1 | 2 |\n| --- | --- |",
    "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>x|y</td></tr></tbody></table>end":
        "| A | B |\n| --- | --- |\n| 1 | x\\|y |\n\nend",
    "<table><tr><td>1<td><b>2<tr><td>3<td>4</table>": "| 1 | **2** |\n| --- | --- |\n| 3 | 4 |",
    "<table><tr><td><p>a</p><p>b</p></td><td>c<br>d</td></tr></table>": "| a b | c d |\n| --- | --- |",
    "<table><tr><td>out<table><tr><td>in</td><td>ner</td></tr></table></td><td>x</td></tr></table>": "| out in ner | x |\n| --- | --- |",
    "text<table><tr><td>open": "text\n\n| open |\n| --- |",
    # links and images
    "see <a href=\"/x?a=1&amp;b=2\">this <b>page</b></a>!": "see [this **page**](/x?a=1&b=2)!",
    "<a name=x>plain</a> <a href=''>empty</a> <A HREF=/y>up</A>": "plain [empty]() [up](/y)",
    "<img src='a.png' alt=\"a &gt; b\">": "![a > b](a.png)",
    # marks
    "a<b> b </b>c <i></i>d <em>e</em>": "a **b** c d *e*",
    "<b>x<br>y</b>": "**x**\n**y**",
    "<p><b>open<p>next": "**open**\n\nnext",
    "<b><i>m</b>n</i>": "***m***n",
    "<b><strong>once</strong></b> <s>gone</s> <code>x < y</code>": "**once** ~~gone~~ `x < y`",
    "</b></p></ul>stray</li>": "stray",
    # code
    "<pre><code>def f(x):\n    return x &lt; 1\n</code></pre>tail": "```\ndef f(x):\n    return x < 1\n```\n\ntail",
    "<pre>\na  b\n\n\n\nc</pre>": "```\na  b\n\n\n\nc\n```",
    "<pre>a<br>b": "```\na\nb\n```",
    "<ol><li>a<pre>x\ny</pre><li>b</ol>": "1. a\n\n    ```\n    x\n    y\n    ```\n\n2. b",
    # blocks
    "<h1>T <i>it</i></h1><h3>sub<br>head</h3>text": "# T *it*\n\n### sub head\n\ntext",
    "<blockquote>one<p>two</p><ul><li>x</li></ul></blockquote>end": "> one\n>\n> two\n>\n> * x\n>\nend",
    "a<hr>b": "a\n\n---\n\nb",
    # entities, other text
    "&lt;p&gt; &#233;&#xE9;&eacute; &amp;amp; &nope; & &#0; x": "<p> ééé &amp; &nope; & � x",
    "a < b and c <d": "a < b and c <d",
    "<p title='a > b'>x</p>": "x",
    "<!-- <p>no</p> -->x<script>if (a<b) {}</script><style>p{}</style><head><title>t</title></head>y<!doctype html>z": "xyz",
    "<script>never closed": "", "x<!-- never closed": "x", "": "", "   \n ": "",
    "one\n  two\t three": "one two three",
}


@pytest.mark.parametrize("html", GOLDEN)
def test_golden(html):
    assert convert(html).strip() == GOLDEN[html]


class _Words(HTMLParser):
    """The words of a page by the standard parser, without head, scripts and styles."""

    def __init__(self):
        super().__init__()
        self.words, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])
        self.words.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")
        self.words.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_every_page_keeps_its_words_and_links(spark):
    rows = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/pages.parquet").select("html", C.html_to_markdown("html").alias("md")).collect()
    assert len(rows) > 100
    only = lambda x: re.sub(r"[^\w]+", "", x)
    for r in rows:
        page = _Words()
        page.feed(r.html)
        page.close()
        assert all(f"]({link})" in r.md for link in page.links)
        text = re.sub(r"\]\([^\s()]*(?:\([^\s()]*\))*[^\s()]*\)", "]", r.md)
        assert only(text) == only("".join(page.words))
        assert not re.search(r"\n{3}|<p>|</", r.md)


def test_long_and_hostile_pages_take_linear_time():
    pieces = ["<li>some <b>text</b> here</li>", "<b>x", "<b>x<br>", "<a href=x>", "<a '", '<a "', "<", "</i><b>", "<ul><li>", "<table><tr><td>",
              "&amp", "<!--", "<script>", "<blockquote>", "<pre>", "<p"]
    for piece in pieces:
        spent = []
        for n in (400, 4000):
            html = piece * n
            start = time.perf_counter()
            convert(html)
            spent.append(time.perf_counter() - start)
        nested = piece in ("<ul><li>", "<blockquote>")  # their indent is part of the output
        assert spent[1] < (200 if nested else 40) * spent[0] + 0.2, piece


def test_nulls_and_noise(spark):
    df = spark.createDataFrame([(1, None), (2, "1 / 2Plain &amp; simple"), (3, "Copy12 chars / 3 words<div class='a'><span>x</span></div>")], "i int, h string")
    got = {r.i: r.m for r in df.select("i", C.html_to_markdown("h").alias("m")).collect()}
    assert got == {1: None, 2: "Plain & simple", 3: "x"}


def test_conversations_use_it_and_another_converter(spark):
    schema = "id string, ord long, model string, plugins string, conversations array<struct<from:string,value:string>>"
    df = spark.createDataFrame([("a", 0, None, None, [("human", "<ul><li>first question</li></ul>"), ("gpt", "<table><tr><td>1</td><td>2</td></tr></table>")])], schema)
    got = C.clean_html_conversation(df).first()
    assert got.error_code == 0 and [m["value"] for m in got.conversations] == ["* first question", "| 1 | 2 |\n| --- | --- |"]
    upper = C.clean_html_conversation(df, convert=lambda v: F.upper(v)).first()
    assert upper.conversations[0]["value"] == "<UL><LI>FIRST QUESTION</LI></UL>"
