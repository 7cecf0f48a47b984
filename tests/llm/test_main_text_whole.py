import pytest

from quillspark.llm import html

PLAIN = "<html><body><nav><ul>" + "<li><a href=/a>a</a></li>" * 8 + "</ul></nav><article><h1>A title</h1><p>" + "word " * 150 + "</p></article><footer>foot words</footer></body></html>"
LINKS = "".join(f"<li><a href=/{i}>more {i}</a></li>" for i in range(40))


@pytest.fixture(scope="module")
def weights(spark):
    return html.fit(spark.createDataFrame([(i, PLAIN) for i in range(20)], "page_id long, html string"))


@pytest.mark.parametrize("inner", [f"<aside><ul>{LINKS}</ul></aside>", f"<form>{LINKS}</form>", f'<div class="ads">{LINKS}</div>', f'<div class="comments"><ul>{LINKS}</ul></div>'])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_elements_that_are_left_out_do_not_cut_an_article(weights, inner, outer):
    page = f"<html><body><{outer}><h1>Short title</h1><p>A lead of few words.</p>{inner}<p>{'rest ' * 300}</p></{outer}></body></html>"
    assert html.region(page, weights) == "Short title\n\nA lead of few words.\n\n" + " ".join(["rest"] * 300)


def test_a_long_list_does_not_cut_an_article(weights):
    page = f"<html><body><article><h1>Short title</h1><p>A lead.</p><ul>{LINKS}</ul><p>{'rest ' * 300}</p></article></body></html>"
    text = html.region(page, weights)
    assert text.startswith("Short title\n\nA lead.\n\nmore 0\n\nmore 1") and text.endswith("rest")


@pytest.mark.parametrize("kept", [
    '<section id="discussion"><p>kept words here</p></section>', '<section id="related-work"><h2>kept words here</h2></section>', '<h2 id="related-work">kept words here</h2>', '<h2 id="social-media">kept words here</h2>', '<h2 id="search">kept words here</h2>',
    '<p class="ad-hoc">kept words here</p>', '<div class="side-by-side">kept words here</div>', '<p><a href="/hidden-valley.html">kept words here</a></p>', '<p title="the hidden cost">kept words here</p>', '<p><a href="/p?id=comments">kept words here</a></p>', '<p data-id="search">kept words here</p>',
])
def test_accidental_names_keep_their_text(kept):
    assert "kept words here" in html.region(f"<body><p>{'word ' * 90}</p>{kept}<p>{'word ' * 90}</p></body>", html.Weights())


@pytest.mark.parametrize("out", ['<div class="sidebar">', '<div class="top-menu">', '<div id="cookie-notice">', '<div id=comments>', '<div class="x relatedPosts">', "<div hidden>", '<div style="display: none">', '<div role="navigation">'])
def test_names_that_say_so_are_left_out(out):
    assert "gone" not in html.region(f"<body><p>{'word ' * 90}</p>{out}gone words here</div><p>{'word ' * 90}</p></body>", html.Weights())
