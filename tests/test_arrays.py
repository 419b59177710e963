"""Matrices that are taken from the arrays they were read off, not from cells dealt out again."""

import dataclasses

import numpy as np
import pytest

from quern import queries
from quern.operators.tensor import Tensor
from quern.plans import linalg

A = np.random.default_rng(9).standard_normal((5, 8))
ROWS = [(0, A[0].tolist()), (1, A[1, :6].tolist()), (2, None), (3, []), (4, [*A[4, :3].tolist(), None, *A[4, 4:].tolist()])]


def read(spark, rows=ROWS) -> Tensor:
    return Tensor.from_arrays(spark.createDataFrame(rows, "i long, a array<double>"), "i", "a", (5, 8))


def cells(t: Tensor) -> dict:
    return {tuple(r[c] for c in t.coords): r["v"] for r in t.df.collect()}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("shape", [(5, 2, 2, 2), (5, 2, 4), (5, 4, 2)])
def test_arrays_give_what_their_cells_give(spark, shape, monkeypatch):
    monkeypatch.setattr(linalg, "STACK", 12)
    t = read(spark).reshape(shape)
    apart = dataclasses.replace(t, arrays=None)
    for fn in (linalg.t_svd_values, lambda x: linalg.t_qr(x)[1]):
        got, want = cells(fn(t)), cells(fn(apart))
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], equal_nan=True) for k in want)
    assert np.isnan(cells(linalg.t_svd_values(t))[(4,) + (0,) * (len(shape) - 2)])


def test_nothing_but_arrays_is_dealt_out(spark):
    for name in ("linalg_svd_values", "linalg_svd_values_large", "linalg_det", "linalg_slogdet", "linalg_det_large", "linalg_slogdet_large"):
        text = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Sort" not in text and text.count("Generate") == 1 and text.index("Generate") < text.index("MapInArrow"), name  # the results alone are cells


def test_changed_cells_are_not_taken_from_arrays(spark):
    t = read(spark, [(i, x.tolist()) for i, x in enumerate(A)])
    for changed in (t * 2, t.flip(1), t.reshape((10, 4)), t.transpose(), t.expand_dims(0), t.slice((slice(0, 3),))):
        assert changed.arrays is None
    got = linalg.t_svd_values((t * 2).reshape((5, 2, 4))).to_numpy()
    assert np.allclose(got, np.linalg.svd(2 * A.reshape(5, 2, 4), compute_uv=False))
    v, tau = (x.to_numpy() for x in linalg.t_householder(t))
    for row, a, b in zip(A, v, tau):
        assert np.allclose((row - b[0] * (a @ row) * a)[1:], 0)


def test_arrays_beyond_their_shape_are_refused(spark):
    long = read(spark, [(0, [1.0] * 9)]).reshape((5, 2, 4))
    with pytest.raises(Exception, match="more than 8 elements"):
        linalg.t_svd_values(long).df.collect()


def test_the_gradient_of_squares_keeps_nothing(spark):
    text = plan(queries.QUERIES["autodiff_tensor"](spark, "/root/testdata/sf0.001"))
    assert not any(k in text for k in ("Join", "Sort", "Aggregate", "Repartition", "Window", "MapIn")) and text.count("Generate") == 1
