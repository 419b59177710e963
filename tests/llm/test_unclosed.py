"""Pages that leave elements open keep their text."""

import pytest

from quern.llm import htmltext


@pytest.mark.parametrize("page", ["<html><head><title>T</title><meta charset=x><body><p>Some text.</p>", "<head><title>T</title><header>x</header><p>Some text.</p>", "<button>go <p>Some text.</p>", "<noscript><p>Some text.</p>", "<object></objects><p>Some text.</p>"])
def test_unclosed_elements_keep_text(page):
    assert "Some text." in htmltext.parse(page).runs.values() and "T" not in htmltext.parse(page).runs.values()


def test_closed_head_gives_the_same_tree():
    body = "<body><article><h1>A</h1><p>Some text.</p></article></body>"
    p = htmltext.parse(f"<html><head><title>T</title><meta charset=x><script>x</script></head>{body}</html>")
    q = htmltext.parse(f"<html>{body}</html>")
    assert (p.parent, p.names, p.runs) == (q.parent, q.names, q.runs) and htmltext.parse("<p>a</p><script>b<p>c</p>").runs.keys() == {2}
    htmltext.parse("<button>" * 20_000)
