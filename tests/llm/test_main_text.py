"""Page differencing on long boilerplate and on marked articles."""

import pytest

from weft.llm import html_extract as H

BOILERPLATE = "<div>Site menu with many entries of every kind</div><div>{}</div><div>Legal text that goes on and on, longer than any story here by far</div>"


def text(pages, at):
    lines = [H.page_lines(p) for p in pages]
    near = [lines[i] for i in (at - 1, at + 1) if 0 <= i < len(lines)]
    return H.main_text(lines[at], near, 0.5)[0]


@pytest.mark.parametrize("at", [0, 1, 2])
def test_boilerplate_longer_than_the_story_is_deleted(at):
    pages = [f"<body>{BOILERPLATE.format(f'story {x} is short here')}</body>" for x in ("one", "two", "three")]
    assert text(pages, at) == f"story {('one', 'two', 'three')[at]} is short here"


def test_a_copy_is_passed_over():
    pages = [f"<body>{BOILERPLATE.format(x)}</body>" for x in ("one story of its own", "another story, quite", "another story, quite")]
    assert text(pages, 1) == "another story, quite"
    assert "another story, quite" in text(pages, 2)  # its only neighbour is a copy


def test_shared_lines_of_marked_articles_are_deleted():
    page = "<body><article><h1>{0}</h1><p>The text of {0}, which no other page has</p><p>Read more of our best stories</p></article></body>"
    pages = [page.format(x) for x in ("one", "two", "two")]
    assert text(pages, 0) == "one The text of one, which no other page has"
    assert text(pages, 1) == "two The text of two, which no other page has"
    assert text(pages, 2).startswith("two The text of two")  # its only neighbour is a copy
