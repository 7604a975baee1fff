"""Main text: the page reader by hand-worked cases, the model against sums over all labellings."""

import itertools
import random

import numpy as np
import pytest

from tests.llm.conftest import SF
from vacantia.llm import html_extraction as H


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return H.trained(pages)


def all_text(page):
    parsed = H.parse(page)
    return H.text_of(parsed, np.ones(len(parsed.parent), bool))


@pytest.mark.parametrize("page, text", [
    ("<p>a<b>b</b>c</p><p>d", "abc d"),
    ("<p>one <i>two</i>\n\t three&nbsp; &amp;amp; &#38;lt; &#x41;&copy; &notit; &am", "one two three &amp; &lt; A© ¬it; &am"),
    ("a<br>b<hr>c<wbr>d", "a b cd"),
    ("<div>x<script>if (a < b) '</p>'</script>y<style>p{}</style></div>", "xy"),
    ("x<!-- <p>no</p> -->y<!doctype html><?php z ?>", "xy"),
    ("<p title='a > b' data-x=\"c > d\">t</p>", "t"),
    ("<p title='never closed>t</p> u", "t u"),
    ("1 < 2 and a<b>c</b> <", "1 < 2 and ac <"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a b c d e"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<P>a</P><TEXTAREA>no</textarea><Script>no</SCRIPT >b", "a b"),
    ("<p>cut <a hre", "cut"), ("<scr", ""), ("</p></div>x", "x"), ("<script>open", ""), ("", ""),
    ("<div><p><b>a<p>b</div>c", "a b c"), ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"),
    ("<p>a</p>b<p>c</p>", "a b c"), ("<x-tag>a</x-tag>b", "a b"),
])
def test_reading(page, text):
    assert all_text(page) == text


def test_long_and_deep_pages():
    assert all_text("<div>" * 20_000 + "x") == "x"
    assert all_text("<p>word " * 200_000) == " ".join(["word"] * 200_000)
    assert all_text("<a 'b" * 100_000 + "x") == ""
    assert all_text("<" * 100_000) == "<" * 100_000


def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    trees = H.forest([H.parse("<div><p class=ad>a</p><ul><li>b</li><li>c. d</li></ul></div>"),
                      H.parse("<nav><a href=x>y</a></nav>z")])
    model = H.Model(rng.normal(size=H.FEATURES), rng.normal(size=(H.GROUPS ** 2, 2, 2)))
    content, joint = model.marginals(trees)
    n = len(trees.parent)
    own = np.bincount(trees.node, model.weights[trees.feature], n)
    total, single, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(own[k] for k in range(n) if labels[k])
        score += sum(model.edges[trees.kind[k], labels[trees.parent[k]], labels[k]]
                     for k in range(n) if trees.parent[k] >= 0)
        weight = np.exp(score)
        total += weight
        single += weight * np.array(labels)
        for k in range(n):
            if trees.parent[k] >= 0:
                pair[k, labels[trees.parent[k]], labels[k]] += weight
    child = trees.parent >= 0
    assert np.allclose(content, single / total)
    assert np.allclose(joint[child], pair[child] / total)


def test_training_climbs_to_the_labels():
    parsed = [H.parse(f"<div><p>{'long text, ' * 9}</p><ul><li>x</li></ul></div>") for _ in range(3)]
    labels = np.array([name in ("p",) for p in parsed for name in p.name]).astype(int)
    trees = H.forest(parsed)
    assert ((H.fit(trees, labels).marginals(trees)[0] >= 0.5) == labels).all()


def test_given_pages(model, pages):
    """Article text of every page, as its own tags have it."""
    for row in pages.collect():
        inner = row.html.split("<article>")[1].split("</article>")[0]
        assert H.extract(model, [row.html]) == [all_text(inner)], row.page_id


def test_held_out_layouts(model, spark):
    """Pages of another table in layouts that were not trained on: nodes and characters."""
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").where("page_id >= 200").collect()
    pick, right, nodes, kept, wanted, both = random.Random(99), 0, 0, 0, 0, 0
    for row in rows:
        parsed = H.parse(H.relabelled(row.html, pick))
        labels = H.labels_of(parsed)
        bare = H._without_marks(parsed)
        guess = model.marginals(H.forest([bare]))[0] >= 0.5
        size = np.zeros(len(labels))
        for n, text in parsed.pieces:
            size[n] += len((text or "").strip())
        right, nodes = right + ((guess == labels) & (size > 0)).sum(), nodes + (size > 0).sum()
        kept, wanted = kept + size[guess].sum(), wanted + size[labels == 1].sum()
        both += size[guess & (labels == 1)].sum()
    assert right / nodes > 0.98
    assert both / kept > 0.99 and both / wanted > 0.98


def test_plain_layouts(model):
    prose = "<p>" + "The first of many plain sentences, with words. " * 6 + "</p>"
    page = f"""<html><body><header><h1>Site</h1><nav><a href=a>A</a> <a href=b>B</a></nav></header>
      <div class="cookie-notice"><p>We use cookies, as all do.</p><button>OK</button></div>
      <main><article><h1>Title here</h1>{prose}{prose}<div class="ad">Buy this now.</div>{prose}</article>
      <section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree, not at all.</p></div>
      </section></main><aside class="sidebar"><h3>Related</h3><ul><li><a href=c>C</a></li></ul></aside>
      <form class="newsletter"><label>Mail</label><input><button>Go</button></form>
      <footer>&copy; Site. All rights.</footer></body></html>"""
    text, = H.extract(model, [page])
    assert text == " ".join(["Title here", *[" ".join(all_text(prose).split())] * 3])


def test_defined_cases(spark, model):
    rows = [(1, "u", None, "t", 1), (2, None, "", "t", 2), (None, "v", "<html><body></body></html>", "t", 3),
            (4, "w", "<article><p>" + "Some words, again. " * 9, "t", 4)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extracted(table, model, "page_id", "url").collect()
    assert [(r["_row"].page_id, r.text, r.n_chars) for r in got[:3]] == [(1, "", 0), (2, "", 0), (None, "", 0)]
    assert got[3].text.startswith("Some words") and len(got) == 8 and got[3].text == got[7].text
    none = table.limit(0)
    assert H.extracted(none, H.trained(none), "page_id").collect() == []
