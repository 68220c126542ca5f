from __future__ import annotations

import re
import time
import tracemalloc
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postlake.llm import html_text as H

LONG = "This is a paragraph of running text that is long enough to count as such, and then some more of it."
SCHEMA = "page_id long, url string, html string"


def page(main: str, before: str = "", after: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{before}{main}{after}<footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (page(f"<article><h1>A &amp; B</h1><p>{LONG}<br>more<p><b>{LONG}</b></article>"), f"A & B\n{LONG} more\n{LONG}"),
        (page(f"<div id='main'><div class='post-12'><p>{LONG}</p><div class='comments'><p>{LONG} reader</p></div></div></div>", "<div class='cookie-notice'><p>We use cookies, and we ask you to say that you like it, at some length.</p></div>"), LONG),
        (page(f"<main><p>{LONG}</p><aside><p>{LONG} aside</p></aside><form><p>{LONG} form</p></form></main>", f"<header><p>{LONG} header</p></header>", f"<div class='ad'>{LONG} advert</div>"), LONG),
        (page(f"<article><p>{LONG}\n\n  \t x &#233;&eacute;&hellip;</p><ul><li>one<li>two</ul></article>"), f"{LONG} x éé…\none\ntwo"),
        (f"<body><article><p>{LONG}", LONG),
        (f"<article><p class='ad'>{LONG} advert<p>{LONG}<p id='share-bar'>{LONG} share</p><p style='display: none'>{LONG} hidden</p></article>", LONG),
        (f"<div class='page has-sidebar'><article><div class='post-header'><h1>T</h1></div><p>{LONG}</p></article></div>", f"T\n{LONG}"),
        (f"<section id='respond'><p>{LONG} reply</p></section><div><p>{LONG}</p><section class='reader-responses'><p>{LONG} reader</p></section></div>", LONG),
        (f"<p>{LONG}</p><!-- <p>gone</p> -->", LONG),
        ("plain & simple", "plain & simple"),
        ("", ""),
        ("<script>only</script>", ""),
        ("<p>a < b <c", "a < b"),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data='x'>its text</object> <svg><title>gone</title><text>drawn</text></svg>.</p></article>", f"{LONG} x=2 and its text drawn."),
        (page(f"<article><div class='search-engines'><p>{LONG}</p></div><div id='form-of-address'>{LONG}</div><div class='ad-slot-3'>gone</div><p>{LONG}</p></article>"), f"{LONG}\n{LONG}\n{LONG}"),
        ('<p title="a>b">x</p>', "x"),
    ],
)
def test_one_page(source, want):
    assert H.extract(source, None) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<article><h1>T</h1><div class='content'><p>{LONG}<p>{LONG}</div></article>", ["T", LONG, LONG]),
        (f"<article><div class='intro'><p>{LONG}</div><div class='body'>{f'<p>{LONG}' * 4}</div></article>", [LONG] * 5),
        (f"<div class='post'><div class='intro'><p>{LONG}</p></div><div class='body'>{f'<p>{LONG}</p>' * 12}</div></div>", [LONG] * 13),
        (f"<div class='post'><div class='by'>By me</div><div class='body'>{f'<p>{LONG}</p>' * 40}</div></div>", ["By me"] + [LONG] * 40),
        (f"<div class='post'><div class='a'><div class='x'><p>{LONG}</div><div class='y'><p>{LONG}</div></div><div class='b'><p>{LONG}</div></div>", [LONG] * 3),
    ],
)
def test_split_articles_are_whole(source, want):
    assert H.extract(page(source), None) == "\n".join(want)


def test_the_host_decides(spark):
    shared = "<div class='box3'><p>{}</p></div><div class='story'><p>{}</p></div>"
    rows = [(i, "http://a.io/x", page(shared.format("short", LONG))) for i in range(5)]
    short = LONG[:60]
    rows.append((5, "http://a.io/y", page(shared.format(LONG + LONG, short))))  # by itself it would take the other box only
    rows.append((8, "http://a.io/w", page(shared.format(LONG + LONG, "tiny"))))
    rows.append((6, "http://b.io/y", page(shared.format(LONG + LONG, "tiny"))))
    rows.append((7, "http://a.io/z", page(f"<div class='other'><p>{LONG}</p></div>")))
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(5)] == [LONG] * 5
    assert got[5] == f"{LONG}{LONG}\n{short}" and got[8] == f"{LONG}{LONG}\ntiny"  # nothing gives way for its share
    assert got[6] == LONG + LONG and got[7] == LONG


def test_digits_of_classes_are_one(spark):
    rows = [(i, "http://a.io", page(f"<div class='post-{i}'><p>{LONG}</p></div>")) for i in range(4)]
    assert [r.path for r in H.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()] == [H.path_key(["body", "div.post-#"])]


def test_odd_rows(spark):
    rows = [(1, None, f"<p>{LONG}</p>"), (None, "not a url", None), (2, "http://a.io", ""), (2, "http://a.io", ""), (3, "http://a.io", f"<article><p>{LONG}</p>" + "<div>" * 3000 + "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("mine")).withColumn("path", F.lit("/p")).withColumn("text", F.lit("t"))
    got = sorted(((r.page_id or 0), r.text) for r in H.main_text(df).collect())
    assert got[0] == (0, "") and got[1] == (1, LONG) and got[2:4] == [(2, ""), (2, "")]
    assert got[4] == (3, LONG + "\n" + "x" * 100_000)  # the article round the innermost of 3000 containers
    assert H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("tail", ["", "</p>", "</div>"])
def test_deep_nesting_takes_time_and_memory_in_proportion(tail):
    def page(n: int) -> str:
        return "<div class='a'>" * n + f"<p>{LONG}" + tail * n

    def run(n: int) -> None:
        read = H.Page(page(n))
        path, held = read.vote()
        assert read.text(path) == LONG and held == len(LONG) and path == H.path_key(["div.a"] * n)

    times = []
    for n in (12_500, 100_000):
        start = time.process_time()
        run(n)
        times.append(time.process_time() - start)
    assert times[1] < 24 * times[0] + 0.5  # eight times as deep; 64 times would be the square
    tracemalloc.start()
    run(25_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


def test_a_deep_page_on_its_hosts_path(spark):
    rows = [(i, "http://a.io", "<body>" + "<div>" * 5000 + f"<p>{LONG} {i}") for i in range(3)]
    assert [r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()] == [f"{LONG} {i}" for i in range(3)]


def plain_text(spark, sf_dir):
    """A plain reader of the test pages, by the standard library: all text in articles, block by block."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside = self.skip = 0
            self.blocks = [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("script", "style", "nav", "aside", "form", "footer", "header")
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "blockquote", "pre", "table", "tr", "td", "section", "article", "figure", "figcaption"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.handle_starttag("article-end" if tag == "article" else "div", [])
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style", "nav", "aside", "form", "footer", "header")

        def handle_data(self, data):
            if self.inside > 0 and not self.skip:
                self.blocks[-1] += data

    out = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        out[r.page_id] = [x for x in (re.sub(r"\s+", " ", b).strip() for b in reader.blocks) if x]
    return out


def test_query_against_a_plain_reader(spark, sf_dir):
    got = {r.page_id: r for r in H.op6_main_text(spark, sf_dir).collect()}
    want = plain_text(spark, sf_dir)
    assert set(got) == set(want) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(not (set(got[i].text.split("\n")) - {""}) - set(want[i]) for i in want)  # no text from outside the article
    assert [i for i in want if [x for x in got[i].text.split("\n") if x] != want[i]] == []
