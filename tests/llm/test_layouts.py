"""Main text on layouts of blogs, shops, forums, news and manuals, and in linear time."""

import time

import pytest

from pagecensus.llm.main_text import main_text

P1 = "The committee met on Tuesday and it was decided that the old bridge would be closed for the rest of the year, as the engineers had asked."
P2 = "Most of the people who live on the other side of the river are not happy with this, but they have known about it for some time."
P3 = "It is not clear what will happen to the market on the square when the road to the north is closed as well."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/b">The shop</a></li></ul></nav>'
FOOT = '<footer>&copy; 2026 The Paper. All rights reserved. <a href="/p">Privacy</a></footer>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{NAV}{body}{FOOT}</body></html>"


LAYOUTS = {
    "article": (f"<article><h1>The bridge</h1><p>{P1}</p><p>{P2}</p></article>", ["The bridge", P1, P2]),
    "no-sidebar wrapper": (f'<div class="page no-sidebar"><h1>The bridge</h1><p>{P1}</p><p>{P2}</p></div>', ["The bridge", P1, P2]),
    "has-menu body": (f'<div class="layout has-menu with-sidebar"><article><p>{P1}</p></article></div>', [P1]),
    "ad-free": (f'<div class="ad-free"><article><p>{P1}</p></article></div>', [P1]),
    "entry header": (f'<article><div class="entry-header"><h1>The bridge</h1></div><p>{P1}</p></article>', ["The bridge", P1]),
    "related work": (f'<article><p>{P1}</p><section class="related-work"><p>{P2}</p></section></article>', [P1, P2]),
    "related posts": (f'<article><p>{P1}</p><p>{P2}</p></article><div class="related-posts"><p>{P3}</p></div>', [P1, P2]),
    "linked item": (f'<article><p>{P1}</p><ul><li><a href="/x">the report of the engineers</a></li></ul><p>{P2}</p></article>', [P1, "the report of the engineers", P2]),
    "menu inside": (f'<article><p>{P1}</p><ul>{"".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(9))}</ul><p>{P2}</p></article>', [P1, P2]),
    "copyright inside": (f"<article><p>{P1}</p><p>© is the sign that the author put under the text.</p></article>", [P1, "© is the sign that the author put under the text."]),
    "formula": ("<article><p>It is known that <math><mi>a</mi><mo>=</mo><mn>2</mn></math> for all of the cases that were seen by the two of them.</p></article>", ["It is known that a=2 for all of the cases that were seen by the two of them."]),
    "object": (f"<article><p>{P1}</p><p>The <object data=x>map of the town</object> is on the wall of the old school, and it is for all to see.</p></article>", [P1, "The map of the town is on the wall of the old school, and it is for all to see."]),
    "newsletter line": (f"<article><p>{P1}</p><div>Subscribe to our newsletter</div><p>{P2}</p></article>", [P1, P2]),
    "blog": (f'<div id="content"><div class="post"><h2 class="post-title">The bridge</h2><div class="post-body"><p>{P1}</p><p>{P2}</p></div></div></div><div id="sidebar"><h3>Archive</h3><p>The posts of the year are here</p></div>', ["The bridge", P1, P2]),
    "forum": (f'<main><div class="message"><p>{P1}</p></div><div class="message"><p>{P2}</p></div></main><div class="login-box">You are not logged in to the site</div>', [P1, P2]),
    "shop": (f'<main><h1>A lamp</h1><div class="description"><p>{P1}</p></div><form><button>Buy the lamp now</button></form></main><div class="recommended"><p>{P2}</p></div>', ["A lamp", P1]),
    "news": (f'<div class="banner">The best of the offers of the day for you</div><div class="story"><h1>The bridge</h1><p>{P1}</p><p>{P2}</p></div><aside><p>{P3}</p></aside>', ["The bridge", P1, P2]),
    "manual": (f"<main><h1>How to use it</h1><p>{P1}</p><pre>run the thing</pre><table><tr><td>a</td><td>the first of the two</td></tr></table><p>{P2}</p></main>", ["How to use it", P1, "run the thing", "a", "the first of the two", P2]),
    "cookie bar": (f'<div class="cookie-notice"><p>We use cookies on this site to make it better for all of you and for us, and that is what the law asks us to say here.</p></div><article><p>{P1}</p></article>', [P1]),
    "comments": (f'<article><p>{P1}</p></article><section id="comments"><p>{P2}</p><div class="comment-body"><p>{P3}</p></div></section>', [P1]),
    "comments in article": (f'<article><p>{P1}</p><div class="comments"><article><p>{P2}</p></article></div></article>', [P1]),
    "hidden": (f'<article><p>{P1}</p><div style="display: none"><p>{P2}</p></div></article>', [P1]),
    "sidebar around all": (f'<div class="sidebar"><h1>The bridge</h1><p>{P1}</p><p>{P2}</p></div>', ["The bridge", P1, P2]),
    "tables": (f"<table><tr><td>{NAV}</td><td><p>{P1}</p><p>{P2}</p></td></tr></table>", [P1, P2]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    body, want = LAYOUTS[name]
    assert main_text(page(body)).split("\n") == want


@pytest.mark.parametrize("piece", ["<svg>", "<div>", "</div>", "</p>", "<select>", "<article>", '<div class="ad">', "<b>", '<a href="', "<!-", "<p></div>", "<nav><article>"])
def test_a_megabyte_of_unclosed_tags_takes_linear_time(piece):
    begin = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)) + "the end of it")
    assert time.perf_counter() - begin < 8  # about a second on a free core
