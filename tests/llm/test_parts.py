"""Top-k over several parts and trees: exact, sparing distances on clustered vectors, defined for huge numbers."""

import numpy as np
import pytest

from quern.llm import mtree


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)


def brute(ids, x, k, every, scale):
    q = [[int(np.floor(c * scale)) for c in v] for v in x]
    out = []
    for i, v in zip(ids, q):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in zip(ids, q) if j != i)[:k]
            out += [(i, r, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def clustered(rng, n, clusters=40, dim=8):
    centres = rng.standard_normal((clusters, dim)) * 6
    return centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * 0.1


@pytest.mark.parametrize("shard,block,kind", [(100, 16, "clusters"), (64, 8, "noise"), (50, 4096, "copies")])
def test_parts_by_brute_force(spark, monkeypatch, shard, block, kind):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "BLOCK", block)
    monkeypatch.setattr(mtree, "LEAF", 16)
    monkeypatch.setattr(mtree, "PIVOTS", 6)
    rng = np.random.default_rng(1)
    x = clustered(rng, 700) if kind == "clusters" else rng.standard_normal((700, 8))
    if kind == "copies":
        x[100:400] = x[0]
    got = sorted(map(tuple, mtree.top_k(frame(spark, x), every=10, k=7).collect()))
    assert got == brute(range(len(x)), x, 7, 10, 64)


def test_clustered_vectors_spare_distances(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 400)
    monkeypatch.setattr(mtree, "LEAF", 32)
    rng = np.random.default_rng(2)
    x = clustered(rng, 6000)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert mtree.cost(frame(spark, x), every=20, k=20, scale=4096) < 0.35


def test_huge_numbers(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 3)
    x = [[1e18, 1.0], [1e18, 2.0], [-1e18, 3.0], [3.0, 1.0], [2.0, 1e18], [1e18, -5.0], [1e200, 1.0]]
    got = sorted(map(tuple, mtree.top_k(frame(spark, x), every=1, k=3, scale=64).collect()))
    keep = [i for i, v in enumerate(x) if max(map(abs, v)) * 64 <= mtree.HUGE]
    assert len(keep) == 6 and got == brute(keep, [x[i] for i in keep], 3, 1, 64)


def test_of_rows_of_one_id_the_same_asks(spark):
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])]
    got = {tuple(sorted(map(tuple, mtree.top_k(spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(n)).collect()))) for r in (rows, rows[::-1]) for n in (1, 3)}
    assert len(got) == 1 and len(got.pop()) == 2
