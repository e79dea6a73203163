"""Page text: the cut and the whole extraction against brute force, and broken markup."""

import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pandas as pd

from rillstone.llm import page_text

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Text of the article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words, self.parts = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in page_text.BLOCK:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in page_text.BLOCK:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_query_equals_a_plain_parser(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    got = page_text.query(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, page in pages.html.items():
        parser = Article()
        parser.feed(page)
        assert got.text[i] == " ".join("".join(parser.parts).split())
        assert got.n_chars[i] == len(got.text[i])


def test_cut_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        own = [float(x) for x in rng.integers(-8, 9, n)]
        edges = [(int(a), int(b), float(rng.integers(1, 5))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        cost = lambda side: sum(x for x, s in zip(own, side) if x > 0 and not s) + sum(-x for x, s in zip(own, side) if x < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        assert abs(cost(page_text.min_cut(own, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_nothing_is_lost_to_end_tags():
    article = "<article><p>The article goes on here, as it should.</p></article>"
    for before in ("<script>x</SCRIPT>", "İ<style>y</sTyLe >", "<p>İ</p><script>var a = '</p>'</Script>", "<button>", "<select><option>", "<iframe>", "<video>", "<svg><path></SVG>", "<noscript>"):
        assert "The article goes on here, as it should." in page_text.main_text(before + article), before
    review = "<p>One long review of a film that was shown.</p><p>Another paragraph of the review.</p>"
    assert page_text.main_text(f'<article><div class="reviews">{review}</div></article>') == "One long review of a film that was shown. Another paragraph of the review."
    assert page_text.main_text(f'<article>{review}</article><div class="comments"><p>I say so too, and more of it.</p></div>') == "One long review of a film that was shown. Another paragraph of the review."
    assert page_text.main_text(None) == page_text.main_text("") == ""
    assert page_text.main_text("<p>A plain text that ends in an unfinished <b tag and more of it").endswith("<b tag and more of it")


def test_time_is_linear():
    for odd in ("<a ", "<a x='", '<p y="', "<button>x ", "<p " + "a" * 9, "&amp", "<!-", "</a ", "<script>"):
        began = time.perf_counter()
        page_text.main_text(odd * 40_000 + "<p>x>'")
        page_text.main_text(odd * 40_000)
        assert time.perf_counter() - began < 8, odd


def test_fit(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = page_text.fit(pages)
    assert weights != page_text.LOOKS and weights["links"] < 0
    assert page_text.fit(pages.limit(0)) == page_text.LOOKS
    assert page_text.fit(spark.createDataFrame([(None,), ("",)], "html string")) == page_text.LOOKS
