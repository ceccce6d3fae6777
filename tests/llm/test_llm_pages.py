"""Main text of pages: names, anchors, comment marks, reader comments, windows against brute force, and time."""

import os
import random
import sys
import time

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from busweave.llm import html_blocks  # noqa: E402

LONG = "Text of an article, long enough to be taken for one by any rule that looks at the length of its lines."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><a name=top><p>{LONG}</p><p>Second</p></body>", [LONG, "Second"]),
        (f"<a href=1>x<a href=2>y</a><p>{LONG}</p>", ["xy", LONG]),
        (f"<article><div class='content has-sidebar'><p>{LONG}</p></div></article>", [LONG]),
        (f"<div class='layout with-sidebar'><article><p>{LONG}</article></div>", [LONG]),
        (f"<div id='page-nav-open'><article><p>{LONG}</article></div>", [LONG]),
        (f"<div class=sidebar><main><h1>Title</h1>{LONG}</main></div>", ["Title", LONG]),
        (f"<section id='responses'><p>{LONG}</section>", [LONG]),
        (f"<article><p class='share-price'>{LONG}<h2 id='social-policy'>Social</h2><p class='menu-of-the-day'>x</article>", [LONG, "Social", "x"]),
        (f"<article><p>{LONG}<p class='comment-on-law'>Law<div class='site-nav'>n</div><ul class='share_buttons'><li>s</ul></article>", [LONG, "Law"]),
        (f"<!-- <article> --><p>{LONG}</p><h2><a href=1>Linked</a></h2><p>Third", [LONG, "Linked", "Third"]),
        (f"<script>'<main '</script><p>{LONG}</p><h2><a href=1>Linked</a></h2><p>Third", [LONG, "Linked", "Third"]),
        (f"<main><p>{LONG}<section><h3>3 Reactions</h3><article>me too</article></section><p>after</main>", [LONG, "after"]),
        (f"<article><p>{LONG}<section><h3>Reactions</h3><p>The mayor spoke.</section></article>", [LONG, "Reactions", "The mayor spoke."]),
        (f"<article><p title=\"a>b\">{LONG}<p title='c>d'>Two<p class=\"x>Three</article>", [LONG, "Two", "Three"]),
    ],
)
def test_text(page, expected):
    assert html_blocks.main_text(page).split("\n") == expected


def by_hand(weights, window, surge):
    """Lines between heavy ones at most ``window - 1`` light lines apart, kept where some window is heavy enough."""
    heavy = [i for i, w in enumerate(weights) if w]
    groups = []
    for i in heavy:
        if groups and i - groups[-1][-1] <= window:
            groups[-1].append(i)
        else:
            groups.append([i])
    spans = [(g[0], g[-1] + 1) for g in groups]
    strong = [(a, b) for a, b in spans if max(sum(weights[max(a, i) : i + window]) for i in range(a - window + 1, b)) >= surge]
    return strong or spans


def test_windows_equal_brute_force():
    draw = random.Random(5)
    for _ in range(3000):
        weights = [draw.choice([0, 0, 0, 1, 5, 40]) for _ in range(draw.randrange(0, 25))]
        window, surge = draw.randrange(1, 6), draw.choice([1, 6, 50, 1000])
        got = html_blocks.regions(weights, window, surge)
        merged = []
        for a, b in by_hand(weights, window, surge):
            merged.append((a, b))
        assert got == merged, (weights, window, surge)


LINKS = "<p><a href=x>link</a></p>" * 3


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<div>Home | About</div>{LINKS}<h1>Title</h1>{LINKS}<p>{LONG}</p>{LINKS}<div>Log in</div>", ["Title", LONG]),
        (f"<p>Opening.</p>{LINKS}<p>{LONG}</p>{LINKS}<ul><li>flour<li>salt</ul>{LINKS}<p>Closing!</p>{LINKS}<p>© 2024 Us. All rights reserved.</p>", ["Opening.", LONG, "flour", "salt", "Closing!"]),
        (f"<div>Home | About</div>{LINKS}<div>Log in</div>", ["Home | About", "Log in"]),
        (f"<main><div>One | Two</div>{LINKS}<p>{LONG}</p>{LINKS}<div>Three</div></main>", ["One | Two", *["link"] * 3, LONG, *["link"] * 3, "Three"]),
    ],
)
def test_short_stretches_around_an_unmarked_article_do_not_surge(page, expected):
    assert html_blocks.main_text(page).split("\n") == expected


@pytest.mark.parametrize("unit", ["<div><b>", '<a "', "<a x='", "<!", "<a href=1>x", "<li class=share>", "<p class=notice><div>"])
def test_time_grows_with_the_length(unit):
    started = time.time()
    html_blocks.main_text(unit * (1_000_000 // len(unit)) + f"<p>{LONG}")
    assert time.time() - started < 20
