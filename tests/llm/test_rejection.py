"""Texts of no learnt language are rejected."""

import numpy as np
import pytest

from quern.llm import langid

LATIN = {"en": "the quick brown fox jumps over the lazy dog and then it runs away from here", "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann weg von hier"}


def rows(labels, n=30):
    rng = np.random.default_rng(0)
    return [(x, *langid.counted(" ".join(rng.permutation(LATIN[x].split())[:9]))) for x in labels for _ in range(n)]


@pytest.mark.parametrize("labels", [["en"], ["de", "en"]])
@pytest.mark.parametrize("calibrated", [True, False])
def test_unseen_scripts_are_rejected(labels, calibrated):
    model = langid.fit(rows(labels), rows(labels) if calibrated else [])
    _, _, out = model.predict(["быстрая коричневая лиса прыгает через ленивую собаку", "すばやい茶色の狐はのろまな犬を飛び越える", LATIN["en"]])
    assert out.tolist() == [True, True, False]


def test_threshold_is_the_calibrated_quantile():
    model = langid.fit(rows(["de", "en"]), rows(["de", "en"]))
    texts = [" ".join(np.random.default_rng(i).permutation(LATIN["en"].split())[:9]) for i in range(5)]
    _, score, _ = model.predict(texts)
    assert model.threshold > 0.5 and score.max() >= model.threshold
