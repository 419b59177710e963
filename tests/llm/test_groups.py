"""Keys are packed before they are dealt out; texts that share a line, but little else, form no clusters."""

import random

import numpy as np
import pytest

from quern.llm import ngrams

from .test_brute import near_copies
from .test_clusters import expected


def test_packed_keys_are_read_as_they_were():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 1 << 40), (30_000, 3000), (200, 1 << 63)):
        keys = np.sort(rng.integers(0, 1 << (ngrams.KEPT - 4), n, dtype=np.uint64))
        owners = rng.integers(0, top, n, dtype=np.uint64)
        row = ngrams.packed(keys, owners)
        assert all(np.array_equal(x, y) for x, y in zip(ngrams.unpacked(*row), (keys, owners)))
    keys, owners = np.sort(rng.integers(0, 1 << 40, 30_000, dtype=np.uint64)), rng.integers(0, 3000, 30_000, dtype=np.uint64)
    assert sum(map(len, ngrams.packed(keys, owners)[:3])) < 6 * len(keys)  # not 16 for each key and id


def test_groups_of_keys_and_crowds(monkeypatch):
    monkeypatch.setattr(ngrams, "CROWD", 3)
    keys = np.array([1, 2, 3, 7, 1, 2, 7, 1, 7, 7, 7, 9, 9], np.uint64)
    ids = np.array([5, 5, 6, 1, 4, 4, 2, 4, 3, 4, 4, 8, 8], np.int64)
    groups, a, b = ngrams.met(keys, ids)
    assert [g.tolist() for g in groups] == [[4, 5]]  # of two keys; one id is no group
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 1), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("seed,num", [(1, 80), (2, 60), (3, 95)])
def test_what_may_link_holds_all_links(seed, num):
    sets = ngrams.shingles(near_copies(random.Random(seed), 150), 4)
    n, s = np.array([len(x) for x in sets]), np.frombuffer(b"".join(map(ngrams.sketch, sets)), np.uint64).reshape(len(sets), -1)
    root = ngrams.alike(n, s, np.ones(len(sets), bool), num, 100)
    both = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * both[i][j] >= num * (n[i] + n[j] - both[i][j])]
    assert linked and all(root[i] == root[j] for i, j in linked) and len(set(root.tolist())) > 10
    assert set(ngrams.alike(n, s, np.arange(len(sets)) != 7, num, 100)[[0, 7, 20]].tolist()) == {0}  # one of which nothing is known


def test_texts_that_share_a_line_are_no_cluster(spark, monkeypatch):
    rng = random.Random(4)
    line = lambda name: " ".join(f"{name}{i}" for i in range(12))
    texts = [f"{line(f'a{i}-')} {line(f's{i}-')}\n{line(f's{i + 1}-')}" for i in range(60)] + [line("b"), line("b") + " " + "c"]
    rng.shuffle(texts)
    seen = []
    monkeypatch.setattr(ngrams, "searched", lambda units, *a, real=ngrams.searched: (seen.append(units.count()), real(units, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r["component_id"] for r in ngrams.link(df).orderBy("doc_id").collect()]
    assert got == expected(texts, 5, 80)[1]
    assert sum(seen) <= 6
