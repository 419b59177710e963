"""Decompositions of many matrices at once."""

import numpy as np

from quern.operators.tensor import Tensor
from quern.plans import linalg


def test_stacks_give_what_single_matrices_give():
    rng = np.random.default_rng(3)
    for n, m in ((2, 2), (5, 3), (3, 5)):
        a = rng.standard_normal((40, n, m))
        a[3], a[4] = 0, np.outer(np.arange(n) + 1.0, np.arange(m) + 2.0)
        k = min(n, m)
        u, s, v = linalg.svds(a, k)
        for i, x in enumerate(a):
            one = linalg.svd(x)
            assert np.allclose(s[i], one[1], atol=1e-6) and np.allclose(u[i] @ np.diag(s[i]) @ v[i], x)
        assert np.allclose(linalg.svds(a, k, False)[0], s)
        assert (u[3] == 0).all() if n >= m else (v[3] == 0).all()
    a[5, 0, 0] = np.nan
    s = linalg.svds(a, 2)[1]
    assert np.isnan(s[5]).all() and np.isfinite(np.delete(s, 5, 0)).all()


def test_values_write_no_factors_and_make_no_lists(spark, monkeypatch):
    monkeypatch.setattr(linalg, "written", lambda *a: (_ for _ in ()).throw(AssertionError("written")))
    monkeypatch.setattr(linalg, "STACK", 30)
    a = np.random.default_rng(4).standard_normal((70, 3, 4, 2))
    got = linalg.t_svd_values(Tensor.load(spark, a.shape, a.ravel().tolist()))
    assert "collect_list" not in got.df._jdf.queryExecution().optimizedPlan().toString()
    assert got.shape == (70, 3, 2) and np.allclose(got.to_numpy(), np.linalg.svd(a, compute_uv=False))


def test_registered_values_take_stacks(spark, monkeypatch):
    from quern import queries

    monkeypatch.setattr(linalg, "svd", None)  # no matrix is taken alone
    monkeypatch.setattr(linalg, "written", lambda *a: (_ for _ in ()).throw(AssertionError("written")))
    for name in ("linalg_svd_values", "linalg_svd_values_large"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() > 0
