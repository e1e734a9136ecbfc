"""Attribute values of any length end at their quote, and pages with unclosed quotes are read in linear time."""

import time

import pytest

from auditframe.llm import html

BODY = "<article><p>" + "Plain words of the article stand here in a long enough line. " * 3 + "</p>{}</article>"


@pytest.mark.parametrize("size", [600, 9_000, 18_000, 300_000])
@pytest.mark.parametrize("quote", "\"'")
def test_long_values_are_no_text(size, quote):
    value = "leak > <b>leak</b> " * (size // 19)
    page = BODY.format(f"<div data-x={quote}{value}{quote} class='menu'>Home of the menu</div><p>The article goes on after the attribute with more words.</p>")
    text = html.main_text(page, html.trained_tree())
    assert "leak" not in text and "Home of the menu" not in text and text.endswith("with more words.")


def test_unclosed_quotes_fall_back_to_the_end_of_the_tag():
    page = BODY.format('<p title="open>The words after an unclosed quote are still text of the article.</p>')
    assert "still text of the article" in html.main_text(page, html.trained_tree())


def test_many_unclosed_quotes_take_no_longer():
    def seconds(count):
        page = "<p title='x>Some words of text. " + '<p title="y>More words.</p> ' * count
        start = time.perf_counter()
        assert len(html.page_blocks(page)) >= 1
        return time.perf_counter() - start

    assert seconds(20_001) < 12 * max(seconds(5_001), 0.05)
