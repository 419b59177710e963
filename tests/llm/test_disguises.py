"""Disguised dots after a plain "@" and between numerals; digit words among numerals."""

import pytest

from quern.llm import pii


@pytest.mark.parametrize(
    "text,found",
    [
        ("ask joe@example[dot]com now", ["joe@example[dot]com"]), ("ask joe@example dot com now", ["joe@example dot com"]), ("joe@example[.]com", ["joe@example[.]com"]), ("a.b@mail.example (dot) org, c@d.org", ["a.b@mail.example (dot) org"]),
        ("host 10[.]0[.]0[.]1 is up", ["10[.]0[.]0[.]1"]), ("host 10 dot 0 dot 0 dot 1 is up", ["10 dot 0 dot 0 dot 1"]), ("at 192.168[.]1.7", ["192.168[.]1.7"]), ("192 dot one six eight dot 1 dot two", ["192 dot one six eight dot 1 dot two"]), ("192.168.one.two", ["192.168.one.two"]),
        ("card 4111 1111 1111 one one one one", ["4111 1111 1111 one one one one"]), ("card one one 4111 1111 1111 1111", []), ("card 4111-1111-one-one-1-1-1111-1111", []), ("four 111 1111 1111 1111", ["four 111 1111 1111 1111"]),
        ("plus 44 seven 700 nine 00123", ["plus 44 seven 700 nine 00123"]), ("+1 (four one five) 555 2671", ["+1 (four one five) 555 2671"]),
        ("joe@home dot", []), ("300 dot 1 dot 1 dot 1", []), ("one 2 three 4", []), ("version 1 dot 2 dot 3", []), ("page one 12 of 100 and 200 300 400", []), ("joe@example.com. The dot is red", []),
    ],
)
def test_added_spans(text, found):
    assert [text[s["start"] : s["end"]] for s in pii.spans(text) if not s["base"]] == found


def test_redacted():
    t = "x 10[.]0[.]0[.]1 y joe@a[dot]com"
    assert pii.redacted(t, pii.spans(t)) == "x [IP] y [EMAIL]"
    long = "one 1 " * 50_000
    assert pii.spans(long) == []
