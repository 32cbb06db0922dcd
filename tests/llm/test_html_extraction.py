import itertools
import re
from html import unescape

import pytest

from threatspark.llm import html_extraction as H, queries


@pytest.fixture(scope="module")
def model():
    return H.train([H.marked_labels(x) for x in H.layout_pages()])


def test_messages_give_exact_marginals(model):
    page = H.parse('<div class="post"><p>One. Two.<b>x</b></p><ul><li><a href=q>menu</a></li></ul></div><footer>f</footer>')
    n, weights = len(page.tags), [sum(model.weight.get(f, 0) for f in e) for e in H.evidence(page)]
    total, ones = 0.0, [0.0] * n
    import math

    for y in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(n):
            w = max(-30.0, min(30.0, weights[i]))
            p *= (1.0 if not i else model.below.get(page.tags[i], model.other)[y[page.parents[i]]][y[i]]) / (1 + math.exp(-w if y[i] else w))
        total += p
        ones = [a + p * b for a, b in zip(ones, y)]
    assert [round(a / total, 9) for a in ones] == [round(m, 9) for m in H.marginals(page, model)]


def test_accuracy_on_layouts_not_trained_on(model):
    right = total = 0
    for html in H.layout_pages(150, seed=77):
        page, labels = H.marked_labels(html)
        right += sum((m > 0.5) == y for m, y in zip(H.marginals(page, model), labels))
        total += len(labels)
    assert right / total > 0.97


def test_query_gives_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1|div|li|ul)\b[^>]*>", "\n", inner)))
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(b)).strip() for b in inner.split("\n")) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


@pytest.mark.parametrize("html,texts", [
    ("a < b &amp; c<p>d<p>e", ["a < b &amp; c", "d", "e"]),
    ("<script>x('</p>')</script><p>y", ["y"]),
    ("<p>open <b>bold <!-- <p>no</p> -->more", ["open ", "bold ", "more"]),
    ('<div title="a>b">t</span></div', ["t"]),
    ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]),
    ("", []),
    ("<", ["<"]),
])
def test_broken_markup(html, texts):
    assert [t for i, t in H.parse(html).events if i >= 0] == texts


def test_odd_rows(spark, model):
    rows = [(1, None, "t"), (1, "", "t"), (None, "<article><p>" + "Long text. " * 30_000 + "</p></article>", "t"), (2, "plain", "t"), (2, "plain", "t")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = H.extract(frame, model).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id == 1] == ["", ""]
    assert [r.text for r in out if r.page_id == 2] == ["plain", "plain"]
    assert [r.n_chars for r in out if r.page_id is None] == [len("Long text. " * 30_000) - 1]
    assert H.extract(frame.where("false"), model).collect() == []
    assert len(H.labelled_pages(frame.where("false"))) == len(H.layout_pages())


@pytest.mark.parametrize("html,text", [
    ("A page of bare text. It has no tag at all, and goes on.", None),
    ("First line of text.\nSecond one.", "First line of text. Second one."),
    ("<p>First paragraph, long enough to count.</p><p>Second paragraph, no shorter.</p>", "First paragraph, long enough to count.\nSecond paragraph, no shorter."),
    ("<article><p>Some text here. More of it.</p></article> A tail after the article. And one more.", "Some text here. More of it.\nA tail after the article. And one more."),
    ("<div class=menu><a href=x>a</a> <a href=y>b</a></div>Some bare text after a menu. It goes on.", "Some bare text after a menu. It goes on."),
    ("<html><body><nav><a href=x>Home</a></nav><article><p>Some text here. More of it.</p></article></body></html>", "Some text here. More of it."),
])
def test_text_outside_elements(model, html, text):
    assert H.main_text(html, model) == (html if text is None else text)
