"""The region against all intervals, what the weights decide, and awkward pages."""

import random
import time

import pytest

from quillspark.llm import html

LINKS = [f"Menu item {i}" for i in range(60)]
BODY = f"<h1>The title of it</h1><p>{'word and word ' * 40}</p><p>{'more and more <a href=x>link</a> with words. ' * 20}</p><p>End of it all with words.</p>"
MENU = " ".join(f"<a href=/{i}>{x}</a>" for i, x in enumerate(LINKS))
FOOT = "<a href=/a>About us</a> <a href=/b>Terms</a> <a href=/c>Contact</a>"
LABELLED = f"<html><body><nav><ul>{''.join(f'<li><a href=/x>{x}</a></li>' for x in LINKS[:8])}</ul></nav><div class=teaser><a href=/y>Elsewhere</a></div><article><h1>A title</h1><p>{'word ' * 150}<b>bold</b></p></article><footer>foot words</footer></body></html>"


@pytest.fixture(scope="module")
def weights(spark):
    return html.fit(spark.createDataFrame([(i, LABELLED) for i in range(20)], "page_id long, html string"))


def naive_text(page, weights):
    """The text by all intervals: the highest sum, then the first end, then the last start."""
    marks, blocks = [], [[]]
    for kind, value, _, _ in html.events(page):
        if kind == "break":
            marks.append(0)
            blocks.append([])
        elif kind == "tag":
            marks.append(weights.tags.get(value, weights.other))
        else:
            marks.append(weights.word * len(value.split()))
            blocks[-1].append((len(marks) - 1, value))
    intervals = [(sum(marks[i:j]), -j, i) for i in range(len(marks)) for j in range(i + 1, len(marks) + 1)]
    best, end, start = max(intervals, default=(0, 0, 0))
    if best <= 0:
        return ""
    texts = [(min(p for p, _ in b), max(p for p, _ in b), " ".join("".join(v for _, v in b).split())) for b in blocks if b]
    return "\n\n".join(t for first, last, t in texts if t and first < -end and last >= start)


def test_text_of_the_best_region_against_all_intervals():
    rng = random.Random(7)
    weights = html.Weights(2, {"b": -1, "/b": -1, "p": -1, "/p": -1, "div": -3, "/div": -3}, -5)
    seen = set()
    for _ in range(150):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<i>", f" {rng.choice('abcd')} one ", " two ", " x y z "]) for _ in range(rng.randint(0, 28)))
        assert html.region(page, weights) == naive_text(page, weights)
        seen.add(naive_text(page, weights))
    assert len(seen) > 50


def test_equal_regions_the_first_stands():
    assert html.region("<div>a b</div><div>c d</div>", html.Weights(1, {}, -9)) == "a b"


@pytest.mark.parametrize("page", [
    f"<html><body><div><div>{MENU}</div><div>{BODY}</div><div>{FOOT}</div></div></body></html>",
    f"<html><body><table><tr><td>{MENU.replace('</a>', '</a><br>')}</td><td>{BODY}</td></tr><tr><td>{FOOT}</td></tr></table></body></html>",
])
def test_fitted_weights_leave_plainly_named_menus_out(weights, page):
    text = html.region(page, weights)
    assert text.startswith("The title of it\n\nword and word") and text.endswith("End of it all with words.") and "Menu" not in text and "Terms" not in text
    assert html.region(page, html.Weights(1.0, {}, -0.05)) != text and html.region(page, html.Weights(0.1, {}, -3.0)) != text


def test_fitted_weights_beat_the_defaults(weights):
    page = f"<html><body><div><div>{MENU}</div><div>{BODY}</div><div>{FOOT}</div></div></body></html>"
    assert "Terms" not in html.region(page, weights) and "Menu" not in html.region(page, weights) and "Menu item 0" in html.region(page, html.Weights())


def test_every_tag_of_the_sample_is_learned(spark):
    page = "<body>" + "".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">x</div>' for i in range(2500)) + "<main><p>some words</p></main></body>"
    found = html.fit(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert sum(t.startswith("div.") for t in found.tags) == 2500 and {"div", "/div", "p"} <= set(found.tags)


@pytest.mark.parametrize("page", [
    "<p>kept words" + "<a" + " x=1" * 1000, "<p>kept words" + "<a" + " x='1' y=\"2\" z" * 1000,
    "<div>" * 50_000 + "kept words" + "</b></i>" * 50_000, "<p>kept words</p>" + "<!" * 100_000, "<p>kept words</p>" + '<a x="y>">' * 50_000 + '<a =">',
    "<p>kept words</p>" + "<a " * 100_000, "<p>kept words</p>" + "<script " * 20_000,
])
def test_awkward_pages_take_linear_time(page):
    start = time.process_time()
    assert html.region(page, html.Weights()) == "kept words"
    assert time.process_time() - start < 3  # a quadratic or exponential scan takes minutes


def test_long_page_and_repeated_rows(spark, weights):
    page = f"<article><p>{'long words ' * 200_000}</p></article>"
    rows = html.extract(spark.createDataFrame([(1, page)] * 2, "page_id long, html string"), weights).collect()
    assert [r["text"] for r in rows] == [("long words " * 200_000).strip()] * 2
