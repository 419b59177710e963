"""Registered queries that SQL can't express, each against a plain version of its own over the whole small tables."""

import hashlib
import html
import re

import numpy as np
import pytest

from quern.llm import common, langid, pieces
from quern.llm.queries import PIECES, QUERIES

from .test_brute import viterbi

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def grams(text):
    """Buckets of a text's letter n-grams, one at a time."""
    x = [0, *[ord(c) if c.isalpha() else 0 for c in text.lower()], 0]
    out, m = [], (1 << 32) - 1
    for n in langid.ORDERS:
        for i in range(len(x) - n + 1):
            part = x[i : i + n]
            if 0 in part[1:-1] or n == 2 and part == [0, 0]:
                continue
            h = part[0] * 0x01000193 & m
            for c in part[1:]:
                h = ((h ^ c) * 0x01000193 + n) & m
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & m) >> 32 - langid.BITS)
    return out


def test_language_id(spark, docs):
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert got.keys() == docs.keys() and all(got[i]["held_out"] == held[i] for i in docs)
    learn = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for i, r in docs.items() if not held[i]], "doc_id long, text string, lang string")
    model = langid.train(learn)
    for i, r in docs.items():
        b = grams(r["text"] or "")
        if not b:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        z = model.logits[b].astype(float).sum(0) / len(b) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert got[i]["lang_pred"] == model.labels[int(p.argmax())] and np.isclose(got[i]["score"], p.max(), atol=1e-6)


def test_sentencepiece(spark, docs):
    v = pieces.load(PIECES)
    got = {r["doc_id"]: r for r in QUERIES["op6_sentencepiece"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in docs.items():
        text = r["text"] or ""
        assert got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"] or []) and got[i]["decoded_bytes"] == len(text.encode())
        if pieces.MARK not in text and len(text) < 4000:
            assert got[i]["ids"] == viterbi(v, text)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PLANTED = [
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 ok", "call +44 (0)20 7946 0958 or +1-202-555-0143x, +12 34", "10.0.0.1 256.1.1.1 1.2.3.4.5 and a.b@c.d.e+f@g.h", "", None, "4" * 40, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "joe@example[dot]com", "über 4111 1111 1111 1111 é x@y.zz",
]


def test_personal_data(spark, docs, tmp_path):
    rows = [(i, r["text"]) for i, r in docs.items()] + [(10**6 + i, t) for i, t in enumerate(PLANTED)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base_spans(text or "")
        said = [f"{kind}:{a}:{b}" for a, _, b, kind in want]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[3] == k for w in want) for k in BASE]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(said) <= set(spans) and len(spans) == len(said) + got[i]["n_added"]
    assert got[10**6 + 7]["spans"] == f"email:0:{len('joe@example[dot]com')}"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_main_text(spark, sf):
    """The tables' pages have one template, so an expression can cut their articles out."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op9_main_text"](spark, f"/root/testdata/{sf}").collect()}
    assert got.keys() == pages.keys()
    for i, r in pages.items():
        inner = re.search(r"<article[^>]*>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h\d|li|ul|ol|blockquote|pre)[^>]*>", "\x01", re.sub(r"<br/?>", " ", inner)))
        blocks = [" ".join(html.unescape(b).split()) for b in inner.split("\x01")]
        want = "\n".join(b for b in blocks if b)
        assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (want, len(want), r["url"])


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)
