"""Extraction without knowing what class names mean, and parsing in linear time."""

import random
import time

import pytest

from quern.llm import htmltext, langid

WORDS = ["The cat sat on the mat.", "It rained a lot yesterday in town.", "Prices, they said, rose again.", "We saw it."]
HELD_OUT = "werbung reklame anzeige kaufen jetzt zusatz kasten kopf fuss leiste meinung kommentar stimme hinweis teilen weiter formular abo suche pfad".split()


@pytest.fixture(scope="module")
def model():
    return htmltext.fit([])


def exact(model, pages) -> float:
    good = 0
    for source, places in pages:
        page = htmltext.parse(source)
        y = htmltext.truth(page, places)
        good += htmltext.texts(model, [source])[0] == "\n".join(page.runs[i] for i in page.runs if y[i])
    return good / len(pages)


def test_names_the_code_does_not_hold(model, monkeypatch):
    rng = random.Random(41)
    assert not any(w in text for w in HELD_OUT for text in htmltext.NAMES.values())
    monkeypatch.setattr(htmltext, "NAMES", {k: " ".join(rng.sample(HELD_OUT, 3)) for k in htmltext.NAMES})
    assert exact(model, [htmltext.generated(rng, WORDS, 1.0) for _ in range(200)]) >= 0.95


def test_made_up_and_common_names(model):
    rng = random.Random(42)
    assert exact(model, [htmltext.generated(rng, WORDS, 0.0) for _ in range(200)]) >= 0.95
    assert exact(model, [htmltext.generated(rng, WORDS, 1.0) for _ in range(200)]) >= 0.97


@pytest.mark.parametrize("name", ["ad", "werbung", "reklame-box", "xk12"])
def test_an_advert_by_any_name(model, name):
    article = "<h1>A title</h1><p>The first paragraph. It goes on for a while.</p>{}<p>Another paragraph, somewhat longer than that. It ends here.</p>"
    want = "A title\nThe first paragraph. It goes on for a while.\nAnother paragraph, somewhat longer than that. It ends here."
    advert = f'<div class="{name}">Buy this now.</div>'
    assert htmltext.texts(model, [f"<body>{advert}<article>{article.format('')}</article></body>", f"<body><article>{article.format(advert)}</article></body>"]) == [want, want]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</x>" * 20_000, "<div>" * 20_000 + "</header>" * 20_000, "<p><body>" + "<header>" * 20_000, "<li><ul>" * 20_000, "<table>" + "<tr><td>" * 20_000])
def test_parsing_is_linear(page):
    began = time.process_time()
    htmltext.parse(page)
    assert time.process_time() - began < 1


def test_samples_are_bounded_though_ids_repeat(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same words' ELSE concat('other words ', id) END AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS lang")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows, apart, **how: seen.append((len(rows), len(apart))))
    langid.train(docs, per_label=50)
    langid.train(docs.union(docs).union(docs), per_label=50)
    assert all(0 < sum(x) <= 200 for x in seen) and len(seen) == 2
    got = []
    monkeypatch.setattr(htmltext, "fit", lambda sources: got.append(len(sources)))
    htmltext.train(docs.selectExpr("1L AS page_id", "text AS html"), sample=40)
    assert 0 < got[0] <= 40
