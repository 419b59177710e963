"""Personal data: offset-preserving deobfuscation, detection, spans in the source's own code points.

Three transducers rewrite a text and keep, for each character that they emit, the source range it stands for:

1. homoglyphs: look-alikes of other scripts, full-width forms, foreign decimal digits, odd dashes and dots become
   ASCII; zero-width characters vanish;
2. spelled digits: runs of five or more digit words (of four languages, "plus" and "dot" among them) become digits;
   shorter ones, and words or disguised dots among numerals, do so if the whole then is a card, IP or phone number;
3. disguises: bracketed or spelled-out "at" and "dot" between the parts of an address become ``@`` and ``.``; a plain
   ``@`` will do if a dot of its domain is disguised.

Identifiers are detected in the source (these are the base spans, always kept) and, only if something was
rewritten, in the rewritten text; spans of the latter that hold a rewritten character and lie in no base span of
their kind are mapped back and added. Any scan is linear in the text's length.

Defined results: null and empty texts have no span. Repeated rows and null ids pass through. Spans are sorted by
start, kind (email, ip, card, phone), end.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str):
    """Leftmost non-overlapping matches, found from each ``@`` outward, so long words cost no second look."""
    low, at = 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while True:
            part = text[max(low, at - width) : at]
            start = at - (len(part) - len(part.rstrip(LOCAL)))
            if start > max(low, at - width) or start == low or at - width <= low:
                break
            width *= 8
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str):
    """(kind's number, start, end) of the plain identifiers."""
    for a, b in emails(text):
        yield 0, a, b
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            yield 1, m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield 2, m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield 3, m.start(), m.end()


# Look-alike letters, each after the ASCII character it passes for.
LOOKALIKES = (
    "aаαɑ bЬ cсϲ dԁ eеєε gɡ hһ iіιı jјϳ kκк lӏ mм nո oоοօ pрρ qԛ sѕ tт uυս vνѵ wԝω xхχ yуγ zᴢ "
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YҮΥ ZΖ "
    "-‐‑‒–—−﹣ .․。｡· @﹫ +﹢"
)
# Characters that take no room, and spaces other than the plain one.
UNSEEN = "​‌‍⁠﻿­"
SPACES = "             　"


def lookalikes() -> dict[str, str]:
    found = {c: word[0] for word in LOOKALIKES.split() for c in word[1:]}
    found |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    found |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x20000) if chr(c).isdecimal()}
    found |= dict.fromkeys(UNSEEN, "") | dict.fromkeys(SPACES, " ")
    return found


ALIKE = lookalikes()

# The digits' names in English, French, German, Spanish.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
NAMED = {w: str(i) for line in DIGIT_NAMES for i, w in enumerate(line.split())} | {"plus": "+", "dot": ".", "point": "."}
_name = "|".join(sorted(NAMED, key=len, reverse=True))
SPELLED = re.compile(rf"\b(?:{_name})(?:[\s,-]{{1,3}}(?:{_name})){{4,}}\b", re.I)
WORD = re.compile(rf"\b(?:{_name})\b", re.I)

NAMES = frozenset(NAMED)


def kind_of(word: str) -> int:
    return 1 if word in NAMES else 2 if word[0].isdigit() else 0


def may_spell(text: str) -> bool:
    """False only if no digit's name can be next to another or to a numeral."""
    text = text.lower()
    for c in ",-.()[]{}<>+":
        text = text.replace(c, " ")
    found = bytes(map(kind_of, text.split()))
    return b"\1\1" in found or b"\1\2" in found or b"\2\1" in found


_open, _close = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
AT = re.compile(rf"{_open}(?:at|@){_close}|(?<=[\w])\s{{1,3}}(?:at|@)\s{{1,3}}(?=\w)|@", re.I)
DOT = re.compile(rf"{_open}(?:dot|\.){_close}|\s{{1,3}}dot\s{{1,3}}", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
ATOM = re.compile(r"[A-Za-z0-9_%+-]+")
#: What a text with a disguised address must hold.
HINT = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|\.)\s{0,3}[\])}>]|\sdot\s", re.I)


#: What numbers in mixed spelling consist of: bracketed dots, names, numerals.
PART = re.compile(rf"(?P<dot>{_open}(?:dot|point|\.){_close})|\b(?P<name>{_name})\b|(?P<num>\+?[0-9]++(?:\.[0-9]++)*+)", re.I)
GAP = re.compile(r"[\s,()-]{1,3}|\.")


class Mapped:
    """A rewritten text; for each of its characters the source's [start, end) and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ordered ranges; each character put in stands for the whole range."""
        texts, starts, ends, news, at = [], [], [], [], 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:a], put]
            starts.append(self.start[at:a])
            ends.append(self.end[at:a])
            news.append(self.new[at:a])
            if put:
                starts.append(np.full(len(put), self.start[a]))
                ends.append(np.full(len(put), self.end[b - 1]))
                news.append(np.ones(len(put), bool))
            at = b
        self.text, self.start, self.end, self.new = "".join(texts), np.concatenate(starts), np.concatenate(ends), np.concatenate(news)


def spelled(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in SPELLED.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end(), NAMED[w.group().lower()]) for w in WORD.finditer(m.group())]
        for k, (a, b, put) in enumerate(words):
            found.append((a, words[k + 1][0] if k + 1 < len(words) else b, put))  # the gap goes with the word before it
    return found


def mixed(text: str) -> list[tuple[int, int, str]]:
    """Edits of names, numerals and disguised dots in a row whose rewritten whole is an identifier.

    A name at either edge may be left out. Gaps go, save single spaces, hyphens and dots between numerals.
    """
    found: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str, bool]] = []

    def closed():
        if any(odd for *_, odd in run):
            for first, last in ((0, 0), (1, 0), (0, 1), (1, 1)):
                part = run[first : len(run) - last]
                if len(part) < 2 or first and not run[0][3] or last and not run[-1][3] or not any(odd for *_, odd in part):
                    continue
                made, edits = [], []
                for k, (a, b, put, odd) in enumerate(part):
                    made.append(put)
                    to, gap = (part[k + 1][0], text[b : part[k + 1][0]]) if k + 1 < len(part) else (b, "")
                    keep = gap if gap == "." or gap and not odd and not part[k + 1][3] else ""
                    made.append(keep)
                    if odd:
                        edits.append((a, to, put + keep))
                    elif gap and not keep:
                        edits.append((b, to, ""))
                whole = "".join(made)
                if len(whole) <= 60 and any(k and a == 0 and b == len(whole) for k, a, b in detect(whole)):
                    found.extend(edits)
                    break
        run.clear()

    for m in PART.finditer(text):
        a, b = m.span()
        kind, said = m.lastgroup, m.group()
        put = "." if kind == "dot" else NAMED[said.lower()] if kind == "name" else said
        if run:
            gap = text[run[-1][1] : a]
            plain = not run[-1][3] and kind == "num"
            if put[0] == "+" or not (gap in (" ", "-") if plain else not gap and (kind == "dot" or run[-1][2] == ".") or GAP.fullmatch(gap)):
                closed()
        run.append((a, b, put, kind != "num"))
    closed()
    return found


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits of "at" and "dot": a spelled-out "at" and a plain "@" count only if some dot of the address is disguised."""
    found, low = [], 0
    for at in AT.finditer(text):
        bracketed = bool(re.search(r"[\[({<]", at.group()))
        a, b = at.span()
        if a < low or not a or text[a - 1] not in LOCAL:
            continue
        label, edits, odd = LABEL.match(text, b), [], False
        end, dots = (label.end(), 0) if label else (b, 0)
        while label:
            dot = re.compile(r"\.").match(text, end) or DOT.match(text, end)
            label = LABEL.match(text, dot.end()) if dot else None
            if label:
                if dot.group() != ".":
                    odd = True
                    edits.append((dot.start(), dot.end(), "."))
                dots, end = dots + 1, label.end()
        if not dots or not (bracketed or odd):
            continue
        # disguised dots of the local part, from the right to the left
        left, stop = [], a
        while True:
            begin = stop - len(text[max(low, stop - 64) : stop]) + len(text[max(low, stop - 64) : stop].rstrip(LOCAL))
            before = [m for m in DOT.finditer(text, max(low, begin - 16), begin) if m.end() == begin]
            if begin == stop or not before or not before[0].start() or text[before[0].start() - 1] not in LOCAL or not (bracketed or odd):
                break
            left.insert(0, (before[0].start(), begin, "."))
            stop = before[0].start()
        found += [*left, *([(a, b, "@")] if at.group() != "@" else []), *edits]
        low = end
    return found


def spans(text: str | None) -> list[dict]:
    if not text:
        return []
    base = list(detect(text))
    found = [(a, k, b, True) for k, a, b in base]
    odd = "" if text.isascii() else "".join(sorted(set(text) & ALIKE.keys()))
    if odd or HINT.search(text) or may_spell(text):
        m = Mapped(text)
        if odd:
            m.edit([(x.start(), x.end(), ALIKE[x.group()]) for x in re.finditer(f"[{re.escape(odd)}]", text)])
        for rewrite in (mixed, spelled, disguised):
            if edits := rewrite(m.text):
                m.edit(edits)
        if m.new.any() or len(m.text) < len(text):
            gone = np.concatenate([[0], np.cumsum(m.new)])
            for k, a, b in detect(m.text):
                start, end = int(m.start[a]), int(m.end[b - 1])
                if (gone[b] > gone[a] or end - start != b - a) and not any(j == k and x <= start and end <= y for j, x, y in base):
                    found.append((start, k, end, False))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted(found)]


def redacted(text: str | None, found: list[dict]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]["start"], found[i]["end"], found[i]["kind"]
        while i < len(found) and found[i]["start"] < end:
            end = max(end, found[i]["end"])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``spans``; one pass over whole texts, no shuffle."""

    def factory():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return lambda texts: [pa.array([spans(t) for t in texts.to_pylist()], kind)]

    return arrow_map(df, [text], f"spans {SPANS}", factory, keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, every identifier in ``text`` replaced by ``[KIND]``; all rows stay."""

    def factory():
        return lambda texts: [pa.array([redacted(t, spans(t)) for t in texts.to_pylist()], pa.string())]

    return arrow_map(df, [text], f"`{text}` string", factory).select(df.columns)
