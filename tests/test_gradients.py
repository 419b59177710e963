"""Derivatives of whole-tensor operations against differences; functions that compose; reflections."""

import numpy as np
import pytest

from quern.errors import QueryError
from quern.operators.tensor import Tensor
from quern.plans import autodiff as ad
from quern.plans import linalg
from quern.plans.differentiable import StateFunction, differentiable

X = np.random.default_rng(3).standard_normal((3, 4))
CASES = {
    "slice": lambda x: (x.slice(slice(0, 3, 2), slice(1, 4)) ** 2.0).sum(), "index": lambda x: (x.slice(1) ** 3.0).sum(), "concatenate": lambda x: (ad.concatenate([x, x * 2.0], 1) ** 2.0).slice(slice(None), slice(2, 7)).sum(),
    "tile": lambda x: (ad.tile(x, 3) * ad.wrap(np.arange(36.0).reshape(9, 4))).sum(), "max": lambda x: (x.max(1) ** 2.0).sum(), "min": lambda x: (x.min(0, True) * 3.0).sum(), "product": lambda x: x.product(1).sum(), "norm": lambda x: x.norm(1).sum(),
    "cast": lambda x: (x.cast("f64") * 2.0).sum(), "log": lambda x: ad.log(x * x + 1.0, 3.0).sum(), "compare": lambda x: ad.cond(x.compare("gt", 0.0), x * x, -x).sum(), "not": lambda x: ad.cond(ad.negation(ad.positive(x)), x * x, -x).sum(),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_gradients(spark, name):
    f = CASES[name](ad.var("x", X.shape))
    g = ad.gradients(f, ["x"])["x"]
    got = np.broadcast_to(ad.numpy(g, {"x": X}), X.shape)
    for at in np.ndindex(X.shape):
        up, down = X.copy(), X.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        assert np.isclose(got[at], (ad.numpy(f, {"x": up}) - ad.numpy(f, {"x": down})) / 2e-6, atol=1e-5), at
    if name in ("slice", "concatenate", "max", "product", "norm", "compare"):
        t = Tensor.load(spark, X.shape, X.ravel().tolist())
        assert np.allclose(ad.tensor(g.broadcast(X.shape), {"x": t}).to_numpy(), got)


def test_products_with_zeros():
    for row in ([0.0, 2.0, 3.0], [0.0, 0.0, 3.0], [1.0, 2.0, 3.0]):
        g = ad.gradients(ad.var("x", (3,)).product(), ["x"])["x"]
        assert np.allclose(ad.numpy(g, {"x": np.array(row)}), [np.prod(row[:i] + row[i + 1 :]) for i in range(3)])


def test_ties_share_a_maximum():
    assert ad.numpy(ad.gradients(ad.var("x", (3,)).max(), ["x"])["x"], {"x": np.array([2.0, 2.0, 1.0])}).tolist() == [0.5, 0.5, 0.0]


def test_chain_rule():
    outer, inner = ad.sin(ad.var("u")), ad.var("x") ** 2.0
    assert np.isclose(ad.numpy(ad.chain_rule(outer, "u", inner, "x"), {"x": 0.7}), np.cos(0.49) * 1.4)
    with pytest.raises(QueryError):
        ad.chain_rule(ad.var("u", (2,)), "u", inner, "x")


def test_functions():
    @differentiable()
    def f(x, y):
        return x * x * y

    @differentiable()
    def g(z):
        return ad.exp(z)

    assert f(3.0, 2.0) == 18 and f.derivative()(3.0, 2.0) == 12 and f.derivative("y")(3.0, y=2.0) == 9 and f.derivative().derivative("y")(3.0, 2.0) == 6
    h = f.of(y=g)
    assert np.isclose(h(3.0, 1.0), 9 * np.e) and np.isclose(h.derivative("z")(x=3.0, z=1.0), 9 * np.e) and isinstance(f(ad.var("a"), 1.0), ad.Node)
    with pytest.raises(QueryError):
        f(1.0)


def test_functions_with_state():
    @differentiable((4, 3), (4, 1), w=np.zeros((3, 1)))
    def loss(x, t, w):
        return ((x @ w - t) ** 2.0).sum()

    rng = np.random.default_rng(1)
    x = rng.standard_normal((4, 3))
    t = x @ np.array([[1.0], [2.0], [-1.0]])
    assert isinstance(loss, StateFunction)
    f, before = loss, loss(x, t)
    for _ in range(300):
        f = f.step(0.05, x, t)
    assert f(x, t) < 1e-2 * before and loss(x, t) == before and np.allclose(loss.gradients(x, t)["w"], 2 * x.T @ (x @ np.zeros((3, 1)) - t))


def test_reflections(spark):
    v, tau = (t.to_numpy() for t in linalg.t_householder(Tensor.load(spark, X.shape, X.ravel().tolist())))
    for row, a, b in zip(X, v, tau):
        r = row - b[0] * (a @ row) * a
        assert np.isclose(abs(r[0]), np.linalg.norm(row)) and np.allclose(r[1:], 0)


def test_large_products_take_blocks(spark, monkeypatch):
    from quern.operators import block, tensor

    monkeypatch.setattr(tensor, "JOINED", 10)
    monkeypatch.setattr(tensor, "EDGE", 2)
    monkeypatch.setattr(block, "HELD", 1)
    a, b = X, X.T @ X
    t = lambda m: Tensor.load(spark, m.shape, m.ravel().tolist())
    assert np.allclose((t(a) @ t(b)).to_numpy(), a @ b)
    assert t(np.array([3.0, 1.0, 2.0, 1.0])).argsort().to_numpy().tolist() == [1, 3, 2, 0]
