import itertools
import re
from html import unescape

import numpy as np
import pytest

from topicloom.llm import page_text
from topicloom.llm.page_examples import labelled_page
from topicloom.llm.page_tree import read_page


@pytest.fixture(scope="module")
def model(spark):
    return page_text.learn(page_text.labelled_pages(spark))


def test_marginals_equal_enumeration(model):
    """Sum-product against the sum over all states of a small tree."""
    tree = read_page("<div class='post'><p>Some words here. And more.</p><p><a href=x>link</a> tail</p></div><nav>menu</nav>")
    woods = page_text.forest([tree])
    found = page_text.marginals(woods, model)
    local = np.zeros((len(tree.parent), 3))
    for node, name in zip(woods.nodes, woods.evidence):
        local[node] += model.evidence.get(name, 0)
    total, mass = np.zeros_like(local), 0.0
    for states in itertools.product(range(3), repeat=len(tree.parent)):
        score = model.root[states[0]] + sum(local[i, s] for i, s in enumerate(states))
        score += sum(model.edge[int(woods.is_text[i]), states[p], states[i]] for i, p in enumerate(tree.parent) if p >= 0)
        weight = np.exp(score - 20)
        mass += weight
        total[np.arange(len(states)), states] += weight
    assert np.allclose(found, total / mass, atol=1e-9)


def test_held_out_pages(model):
    trees = [read_page(labelled_page(i)) for i in range(10_000, 10_200)]
    woods = page_text.forest(trees)
    truth = page_text.true_states(woods, trees) == page_text.MAIN
    spoken = woods.is_text & (woods.size > 0)
    found = page_text.marginals(woods, model)[:, page_text.MAIN] >= 0.5
    assert (found == truth)[spoken].mean() > 0.985


def test_cases(model):
    def text(page):
        return page_text.main_texts([page], model)[0]

    assert text(None) == text("") == text("<div") == text("<!-- <p>no</p>") == ""
    assert text("Plain text without any markup. Really.") == "Plain text without any markup. Really."
    assert text("<p>One &amp; two &lt;b&gt;&nbsp;three\n\t four.<p>Five <i>si</i>x.<br>Seven.") == "One & two <b> three four.\n\nFive six. Seven."
    page = (
        "<header><h1>Site</h1></header><nav><a href=1>Home</a></nav><main><article><h1>T</h1><p>Body text here.</p><aside><p>Related stuff.</p></aside>"
        "<p>More body.<script>x = '</p>'</script><style>p{}</style></article><section id=comments><article><p>I disagree.</p></article></section></main>"
        "<div class='cookie-notice'>We use cookies.</div><form><label>Name</label><input></form><aside><p>Side.</p></aside><footer>&copy; F</footer>"
    )
    assert text(page) == "T\n\nBody text here.\n\nMore body."
    deep = "<div>" * 20_000 + "<p>Deep down. It is here.</p>"
    assert isinstance(text(deep), str)
    assert text("<article>" + "<p>A long page. It goes on.</p>" * 5_000 + "</article>").count("\n\n") == 4_999


def test_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<nav><a href=1>a</a></nav><article><p>Words of it.</p></article>", "x"), (None, "<p>No key.</p>", "x"), (3, "<p>Again.</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = page_text.extract(pages, model)
    assert found.columns == pages.columns
    assert sorted(r.text for r in found.collect()) == ["", "", "Again.", "No key.", "Words of it."]
    assert page_text.extract(pages.limit(0), model).count() == 0
    flat = page_text.learn(pages.select("html").limit(0))
    assert page_text.main_texts(["<p>x</p>"], flat) in (["x"], [""])


def plain_article(page):
    """The given pages keep their main text in one article of headings and paragraphs."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    inside = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\x01", inside)))
    return "\n\n".join(b for b in (" ".join(unescape(b).split()) for b in inside.split("\x01")) if b)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in page_text.extract(pages, model).collect():
        assert r.text == plain_article(r.html)
