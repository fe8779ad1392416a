"""Pages whose tags are not closed are read as far as they go."""

import pytest

from wellspring.llm import html_text

PARAGRAPHS = "<article><h1>Of old wells</h1><p>The first well was dug.</p><p>The second ran dry.</p></article>"
TEXTS = ["Of old wells", "The first well was dug.", "The second ran dry."]


def texts(page):
    return [b.text for b in html_text.flat_blocks(page)]


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>t</title><meta charset=utf-8><style>p{}</style><body>",
        "<html><head><title>t</title><link rel=x><script>a='<p>no'</script>",
        "<head lang=en>\n<noscript><img src=x></noscript>\n",
        "<head><title>t</title></head>",
        "<head></head><object data=x>",
        "<video src=x><audio><noscript>",
        "<select><!-- </select> --><script>'</select>'</script>",
        "<svg><title>no</title><svg>no</svg>no</svg><object>no<object>no</object>no</object>",
        "<object data=x>",
    ],
)
def test_open_tags(before):
    assert texts(before + PARAGRAPHS) == TEXTS
    # A later element of the same kind that is closed doesn't close the open one.
    more = "<object>no</object><video>no</video><select><option>no</select>"
    assert texts(before + PARAGRAPHS + more) == TEXTS


def test_text_ends_a_head_and_raw_text_goes_on():
    assert texts("<head><title>t</title> Wells. <p>Dug.") == ["Wells.", "Dug."]
    assert texts("<p>Dug.<textarea><p>no") == ["Dug."]
    assert texts("<p>Dug.<script>no<p>no") == ["Dug."]


def test_many_open_tags_take_linear_time():
    assert len(texts("<object><p>x" * 20_000)) == 20_000


STORY = "A story of wells that goes on for a while and then some more, about water."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><p title=it's>{STORY}</p><p>{STORY}</p><p class='x' title=that's>{STORY}</p></article>", [STORY] * 3),
        (f"<article class='post tags-news category'><p>{STORY}</p></article>", [STORY]),
        (f"<div class='social-issues story'><p>{STORY}</p></div>", [STORY]),
        (f"<main><p>{STORY}</p><div id='userComments'><p>{STORY}</p></div></main>", [STORY]),
        (f"<main><p>{STORY}</p><div class='relatedposts'><p>{STORY}</p></div></main>", [STORY]),
        (f"<article><header><h1>Of wells</h1><p class=byline>By me</p></header><p>{STORY}</p></article>", ["Of wells", STORY]),
        (f"<header><h1>The Paper</h1></header><article><p>{STORY}</p></article>", [STORY]),
        (f"<article class=comment><p>{STORY}</p></article><article><p>{STORY}</p></article>", [STORY]),
    ],
)
def test_names_and_attributes(page, want):
    assert html_text.main_blocks(page, html_text.trained()) == want


def test_links_around_blocks():
    linked = lambda page: [(b.words, b.linked) for b in html_text.flat_blocks(page)]
    assert linked("<a href=x><div>one two</div><p>three</p></a><p>four</p>") == [(2, 2), (1, 1), (1, 0)]
    # One that isn't closed ends with its block.
    assert linked("<p><a href=x>one</p><p>two</p><p>three <a href=y>four</a></p>") == [(1, 1), (1, 0), (2, 1)]
    assert linked("<p><a href=x>one</p><p>two</p>") == [(1, 1), (1, 0)]
