"""The scores of tag paths decide what is content; tags, roles and classes only say how much of it they need."""

import math
import random

import numpy as np
import pytest

from quotelens.llm import html_extraction
from quotelens.llm.html_extraction import Ratios

PROSE = "It was a long day, and they walked, slowly, up the hill. There was nobody there; nothing moved."
LINKS = "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(12))


def brute_scores(lengths, marks, path, ratios):
    """path_scores by its definition, run by run."""
    n = len(path)
    mean = lambda values, p: sum(v for v, q in zip(values, path) if q == p) / path.count(p)
    near = lambda d: math.exp(-((d / max(1, ratios.radius)) ** 2))

    def smooth(values, i):
        at = range(max(0, i - ratios.radius), min(n, i + ratios.radius + 1))
        return sum(near(j - i) * mean(values, path[j]) for j in at) / sum(near(j - i) for j in at)

    fused = [math.sqrt(smooth(lengths, i) * (smooth(marks, i) + ratios.faint)) for i in range(n)]
    return [mean(fused, p) for p in range(max(path) + 1)]


def test_scores_equal_brute_force():
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        path = sorted(set(p := [rng.randint(0, 4) for _ in range(n)]))
        path = [path.index(x) for x in p]
        lengths, marks = [rng.randint(1, 300) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        for ratios in (Ratios(), Ratios(radius=1, faint=0.5)):
            got = html_extraction.path_scores(np.array(lengths, float), np.array(marks, float), np.array(path), ratios)
            assert got.tolist() == pytest.approx(brute_scores(lengths, marks, path, ratios))


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "<div>{}</div>", "{}"])
def test_link_lists_go_and_headings_stay(inner):
    article = f"<h1>A heading</h1><p>{PROSE}</p><p>{PROSE} <a href='/x'>Here</a> too, of course.</p><ul><li>one thing, at first</li><li>another thing</li></ul><p>{PROSE}</p><ul>{LINKS}</ul><p>{PROSE}</p>"
    page = f"<html><body><ul>{LINKS}</ul>{inner.format(article)}<ul>{LINKS}</ul></body></html>"
    want = ["A heading", PROSE, f"{PROSE} Here too, of course.", "one thing, at first", "another thing", PROSE, PROSE]
    assert html_extraction.main_text(page) == "\n\n".join(want)


def test_constant_scores_select_other_text(monkeypatch):
    """Not the tags decide: without scores the links, the advert and the footer are in the text."""
    page = f"<body><nav><ul>{LINKS}</ul></nav><div class='ad'>Buy this, now. Really.</div><article><h1>T</h1><p>{PROSE}</p><ul>{LINKS}</ul><p>{PROSE}</p></article><footer>(c) all of us.</footer></body>"
    assert html_extraction.main_text(page) == f"T\n\n{PROSE}\n\n{PROSE}"
    monkeypatch.setattr(html_extraction, "path_scores", lambda lengths, marks, path, ratios: np.ones(path.max() + 1))
    assert "Part 3" in html_extraction.main_text(page) and "Buy this" in html_extraction.main_text(page)


def test_equal_pages_long_and_deep_ones(spark):
    deep = "<div>" * 20000 + "<span>" * 20000 + PROSE + "</b>" * 20000
    long = f"<article>{f'<p>{PROSE}</p>' * 5000}</article>"
    rows = [(1, "u", deep, "x"), (2, "u", long, "x"), (2, "u", long, "x"), (3, "u", "<p> </p>" * 3, "x")]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, PROSE), (2, "\n\n".join([PROSE] * 5000)), (2, "\n\n".join([PROSE] * 5000)), (3, "")]
