import html
import re

import pytest

from accesslens.llm import html_text
from accesslens.llm.html_examples import labelled_pages
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table


@pytest.fixture(scope="module")
def model():
    return html_text.train(labelled_pages())


def plain_article(page):
    """The article of the given pages, whose layout is known."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_against_known_layout(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = QUERIES["op4_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == plain_article(pages[row.page_id].html)
        assert row.url == pages[row.page_id].url and row.n_chars == len(row.text)


def test_new_pages_of_the_layouts(model):
    right = wrong = 0
    for page in labelled_pages(6, seed=99):
        nodes = [n for n in html_text.parsed(page, labelled=True) if not n.tag and n.text]
        kept = html_text.main_text(page.replace(" data-keep", ""), model).split("\n")
        for node in nodes:
            same = (node.text in kept) == bool(node.keep)
            right, wrong = right + same, wrong + (not same)
    assert right >= 0.95 * (right + wrong)


def test_marginals_against_enumeration(model):
    page = "<div class=ad><p>x</p></div><article><h1>y z</h1><p>some words.</p></article>"
    nodes = html_text.parsed(page)
    n = len(nodes)
    total, content = 0.0, [0.0] * n
    for state in range(1 << n):
        y = [state >> k & 1 for k in range(n)]
        weight = model.start if y[0] else 1 - model.start
        for k in range(1, n):
            node = nodes[k]
            weight *= model.joins[node.kind][2 * y[node.parent] + y[k]]
            weight *= model.ratio(html_text.evidence(node, nodes[node.parent])) if y[k] else 1
        total += weight
        content = [c + weight * b for c, b in zip(content, y)]
    assert model.marginals(nodes) == pytest.approx([c / total for c in content], abs=1e-9)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no markup at all", None),
        ("<article><p>a &amp; b&nbsp;c\n\n d<p>next <b>bold</b>text</article>", "a & b c d\nnext boldtext"),
        ("<article><p>one<script>var x='</p><p>no';</script> two</p><!-- <p>gone</p> --></article>", "one two"),
        ("<article><ul><li>first item here.<li>second one.</ul></article><p", "first item here.\nsecond one."),
        ("<article><p title='a > b'>kept words.</p></article></div></div>", "kept words."),
        ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
        ("<div>" * 3000 + "deep", None),
        ("<<<>>< p <a <b", None),
    ],
)
def test_markup(model, page, text):
    found = html_text.main_text(page, model)
    assert text is None or found == text


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f()}</script>",
        "<SCRIPT>if(a<b&&c>d)s='it';</ScRiPt >",
        "<script>x='<!--'; y=a<b</script>",
        "<script>s='</scripts>'; t='</p>'; u=\"<b</script>",
        "<style>a<b{}</style><script>a<b</script>",
    ],
)
def test_raw_elements_end_at_their_own_tag(model, raw):
    page = f"<html><head>{raw}</head><body>{raw}<article><p>first words.</p>{raw}<p>last words.</p></article></body>"
    assert html_text.main_text(page, model) == "first words.\nlast words."
    assert html_text.main_text(page + "<script>a<b", model) == "first words.\nlast words."


def test_odd_rows(spark, odd_rows, model):
    rows = odd_rows(text_col="html", key="page_id").withColumnRenamed("source", "url")
    found = html_text.extracted(rows, model)
    assert found.count() == rows.count() and found.where("text is null").count() == 0
    assert html_text.extracted(rows.where("false"), model).count() == 0
