"""Main text by tag-path ratios: against plain path statistics, and on long and broken pages."""

import math
import time
from collections import defaultdict

import numpy as np
import pytest

from strandmill.llm import htmltext

PAGES = "/root/testdata/sf0.001/pages.parquet"


def plain_weights(found):
    """Path ratios by their definition, path by path."""
    groups, order = defaultdict(list), []
    for b in found:
        if b.path not in groups:
            order.append(b.path)
        groups[b.path].append(b)
    size, marks, use = [], [], []
    for p in order:
        use.append(not groups[p][0].out)
        size.append(sum(max(0, len(b.text) - b.linked) for b in groups[p]) / len(groups[p]) if use[-1] else 0)
        marks.append(sum(sum(c in ".,;:!?…。，、；：！？¿¡\"'“”«»()-" for c in b.text) for b in groups[p]) / len(groups[p]) if use[-1] else 0)
    at = lambda x, i: x[min(max(i, 0), len(x) - 1)]
    smooth = lambda x: [0.1 * at(x, i - 1) + 0.8 * x[i] + 0.1 * at(x, i + 1) for i in range(len(x))]
    return {p: s * math.log1p(0.25 + m) * u for p, s, m, u in zip(order, smooth(size), smooth(marks), use, strict=True)}


def test_weights_are_path_ratios(spark):
    rows = [r.html for r in spark.read.parquet(PAGES).select("html").collect()]
    for text in rows[:40]:
        found = htmltext.Page(text).blocks
        want, got = plain_weights(found), htmltext.path_weights(found)
        assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))


def test_weights_decide(spark, monkeypatch):
    """With one weight for all paths every page gets another text, so it is the weights that select."""
    rows = [r.html for r in spark.read.parquet(PAGES).select("html").collect()]
    real = [htmltext.main_text(x) for x in rows]
    monkeypatch.setattr(htmltext, "path_weights", lambda found: {b.path: 1.0 for b in found})
    assert all(htmltext.main_text(x) != y for x, y in zip(rows, real, strict=True))


def test_ratios_select_without_names():
    """No telling tag or class: long punctuated paths stay, link lists and short odd paths go."""
    story = "".join(f"<div class=x1><span>Part {i} of a story, told at length, with commas, stops. And so on, to its end.</span></div>" for i in range(8))
    page = f"<div class=q><a href=/1>One</a></div><div class=q><a href=/2>Two</a></div><div class=r>Short</div>{story}<div class=s><a href=/3>More of it here</a></div>"
    assert htmltext.main_text(page).split("\n") == [f"Part {i} of a story, told at length, with commas, stops. And so on, to its end." for i in range(8)]


def test_excluded_parts():
    text = "<p>" + "A sentence of the article, with a comma, and a stop. " * 4 + "</p>"
    assert htmltext.main_text(f"<div class=ad-box><p>{'Buy it now, really, today. ' * 20}</p></div><div class=body>{text * 3}</div><div id=comments><p>{'I liked it, very much, thanks. ' * 9}</p></div>").count("\n") == 2
    inline = htmltext.main_text(f"<article>{text}<p>Before <span class=advert>buy, <b>now</b></span> after, with a comma.</p></article>")
    assert inline.endswith("Before after, with a comma.") and "buy" not in inline
    wrapped = htmltext.main_text(f"<div class=newsletter>{text * 2}</div><p>x</p>")  # a name around all text is no evidence
    assert wrapped.startswith("A sentence")


@pytest.mark.parametrize(
    "page",
    ['<p class="x' * 90_000, "<div>" * 40_000 + "x" + "</div>" * 40_000, "<a " * 300_000 + '"', "<p a=\"'>" * 100_000, "</p>" * 200_000, "<span>" * 50_000 + "</b>" * 50_000 + "word", "<script></script" * 60_000, "<" * 500_000, "<p " + "a " * 300_000 + ">x", "<div><p>some text here, ok." * 30_000, "<!--" * 200_000, "&#1" * 200_000],
    ids=["unclosed quote", "deep", "open tags", "mixed quotes", "end tags", "inline", "scripts", "signs", "attributes", "nested text", "comments", "references"],
)
def test_long_broken_pages_take_linear_time(page):
    """About 1 MB each; a quadratic step would take minutes."""
    begin = time.monotonic()
    htmltext.main_text(page)
    assert time.monotonic() - begin < 6


def test_long_page_is_whole(spark):
    parts = [f"Paragraph {i} of a very long page, which has commas, stops. And more, as it goes on." for i in range(20_000)]
    rows = spark.createDataFrame([(1, "u", "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>", "clash"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(rows).collect()}
    assert got[1].text == "\n".join(parts) and got[1].n_chars == len(got[1].text) and got[None].text == ""
