import numpy as np
import pytest

from quern.errors import QueryError, Unsupported
from quern.operators.einsum import einsum
from quern.operators.tensor import Tensor


def dense(spark, a):
    return Tensor.load(spark, a.shape, a.ravel().tolist())


def sparse(spark, a):
    return Tensor.load(spark, a.shape, [(tuple(map(int, i)), a[tuple(i)].item()) for i in np.argwhere(a)], dtype="i64" if a.dtype == int else "f64", sparse=True) if a.any() else Tensor.zeros(spark, a.shape, "f64", True)


def number(df):
    return df.first()[0]


RNG = np.random.default_rng(0)


@pytest.mark.parametrize("seed", range(6))
def test_slices_and_writes_agree_with_numpy(spark, seed):
    """Random shapes, indices, steps and lists; numbers and tensors written into what they select."""
    rng = np.random.default_rng(seed)
    shape = tuple(int(d) for d in rng.integers(2, 7, int(rng.integers(1, 4))))
    a = rng.integers(-50, 50, shape)
    t, bounds = dense(spark, a), []
    for d in shape:
        kind, lo = rng.integers(0, 3), int(rng.integers(0, d))
        bounds.append([lo - d if rng.random() < 0.3 else lo, slice(lo, int(rng.integers(lo + 1, d + 1)), int(rng.integers(1, 3))), slice(None)][kind])
    want = a[tuple(bounds)]
    got = t.slice(tuple(bounds))
    assert got == want if want.ndim == 0 else (got.to_numpy() == want).all() and got.shape == want.shape
    picked = [int(i) for i in rng.integers(0, shape[0], 4)]
    assert (t.slice((picked,)).to_numpy() == a[picked]).all()
    for value in (77, rng.integers(0, 9, want.shape) if want.ndim else None):
        if value is not None:
            b = a.copy()
            b[tuple(bounds)] = value
            assert (t.write(tuple(bounds), value if np.ndim(value) == 0 else dense(spark, value)).to_numpy() == b).all()
    for bad in ((shape[0],), (0,) * (len(shape) + 1), (slice(1, 1),)):
        with pytest.raises(QueryError):
            t.slice(bad)


def test_broadcasting(spark):
    a, b = np.arange(20).reshape(5, 2, 2), np.full((2, 5, 1, 2), 3)
    assert ((dense(spark, a) + dense(spark, b)).to_numpy() == a + b).all()
    c, d = np.arange(10).reshape(5, 2, 1), np.arange(5)
    assert ((dense(spark, c) * dense(spark, d)).to_numpy() == c * d).all()
    assert ((dense(spark, np.array([2, 4, 6])) / dense(spark, np.array([2]))).to_numpy() == [1, 2, 3]).all()
    o = dense(spark, np.arange(3).reshape(3, 1)) * dense(spark, np.arange(4).reshape(1, 4))
    assert (o.to_numpy() == np.outer(range(3), range(4))).all()
    with pytest.raises(QueryError):
        dense(spark, a) + dense(spark, np.zeros((3,)))


def test_reductions(spark):
    a = RNG.standard_normal((2, 3, 4))
    t = dense(spark, a)
    for op in ("sum", "max", "min", "mean", "std"):
        f = getattr(np, op)
        assert np.isclose(number(getattr(t, op)()), f(a))
        assert np.allclose(getattr(t, op)(1).to_numpy(), f(a, axis=1)) and np.allclose(getattr(t, op)((0, 2), True).to_numpy(), f(a, axis=(0, 2), keepdims=True))
    assert np.allclose(t.product(1).to_numpy(), a.prod(1)) and np.allclose(t.norm().to_numpy(), np.linalg.norm(a, axis=(1, 2))) and np.allclose(t.norm(2).to_numpy(), np.linalg.norm(a, axis=2))
    assert number(dense(spark, np.arange(1, 7).reshape(2, 3)).product()) == 720 and t.sum(None, True).to_numpy().shape == (1, 1, 1)
    assert number(Tensor.ones(spark, (3, 2)).all()) and not number(Tensor.zeros(spark, (3, 2)).any())


def test_transforms(spark):
    a = np.arange(24).reshape(2, 3, 4)
    t = dense(spark, a)
    assert (t.transpose().to_numpy() == a.T).all() and (t.transpose([1, 0, 2]).to_numpy() == a.transpose(1, 0, 2)).all()
    assert (t.reshape((4, None)).to_numpy() == a.reshape(4, -1)).all() and (t.expand_dims(1).to_numpy() == a[:, None]).all() and (t.flip(2).to_numpy() == a[:, :, ::-1]).all()
    assert (Tensor.concatenate([t, t], -1).to_numpy() == np.concatenate([a, a], -1)).all() and (t.tile(2, 1).to_numpy() == np.tile(a, (1, 2, 1))).all()
    assert [p.shape for p in t.split([1, 2], 1)] == [(2, 1, 4), (2, 2, 4)]
    m = np.arange(9).reshape(3, 3)
    assert (dense(spark, m).diagonal().to_numpy() == np.diag(m)).all()
    v = np.array([3.0, 1.0, 2.0])
    assert dense(spark, v).argsort().to_numpy().tolist() == [1, 2, 0]
    assert (dense(spark, v).binary("gt", 1.5).cond(1, 0).to_numpy() == (v > 1.5)).all()


def test_products(spark):
    a, b = RNG.standard_normal((3, 4)), RNG.standard_normal((4, 5))
    assert np.allclose((dense(spark, a) @ dense(spark, b)).to_numpy(), a @ b) and np.allclose(dense(spark, a).matmul(dense(spark, b), blocks=2).to_numpy(), a @ b)
    c = RNG.standard_normal((2, 3, 4))
    assert np.allclose((dense(spark, c) @ dense(spark, b)).to_numpy(), c @ b)
    x, y = RNG.integers(0, 9, (3, 4, 5)), RNG.integers(0, 9, (4, 3, 2))
    for spec in ("il", "kj", "lkij", "lij"):
        assert (einsum(f"ijk,jil->{spec}", [dense(spark, x), dense(spark, y)]).to_numpy() == np.einsum(f"ijk,jil->{spec}", x, y)).all()
    p, q = RNG.integers(0, 9, (2, 3)), RNG.integers(0, 9, (3, 2))
    for spec in ("ijk", "ij", "ji", "ik", "ki", "jk", "i", "j", "k"):
        assert (einsum(f"ij,jk->{spec}", [dense(spark, p), dense(spark, q)]).to_numpy() == np.einsum(f"ij,jk->{spec}", p, q)).all()
    assert number(einsum("ij,jk->", [dense(spark, p), dense(spark, q)])) == np.einsum("ij,jk->", p, q)
    for bad in ("ii->i", "ij->k", "ij"):
        with pytest.raises(QueryError):
            einsum(bad, [dense(spark, p)])


def test_sparse(spark):
    a, b = np.zeros((3, 4)), np.zeros((3, 4))
    a[0, 1], a[2, 3], b[0, 1], b[1, 1] = 2.0, -3.0, 5.0, 7.0
    s, t = sparse(spark, a), sparse(spark, b)
    for op, f in (("add", np.add), ("sub", np.subtract), ("mul", np.multiply), ("gt", np.greater), ("lt", np.less), ("ne", np.not_equal), ("and", np.logical_and), ("or", np.logical_or), ("xor", np.logical_xor)):
        r = s.binary(op, t)
        assert r.sparse and (r.to_numpy() == f(a, b)).all(), op
        assert r.df.count() == np.count_nonzero(f(a, b))
    d = dense(spark, np.arange(1.0, 5.0))
    assert ((s * d).to_numpy() == a * np.arange(1.0, 5.0)).all() and (s * d).sparse and not (s + d).sparse and ((s + d).to_numpy() == a + np.arange(1.0, 5.0)).all()
    assert ((s / d).to_numpy() == a / np.arange(1.0, 5.0)).all()
    assert (s.sum(0).to_numpy() == a.sum(0)).all() and number(s.min()) == -3.0 and number(s.max()) == 2.0 and number(s.product()) == 0
    assert not number(s.all()) and number(s.any()) and s.read((1, 1)) == 0 and (s.to_dense().to_numpy() == a).all() and s.to_dense().df.count() == 12
    assert (s.write((0, 1), 0).to_numpy()[0] == 0).all() and (s @ d.reshape((4, 1))).sparse
    for bad in (lambda: s + 1, lambda: s.binary("eq", t), lambda: s / t, lambda: s.unary("not"), lambda: s.binary("ge", 0), lambda: s.binary("ne", 1), lambda: s.write((slice(0, 2),), 5)):
        with pytest.raises(Unsupported):
            bad()


def test_complex(spark):
    a, b = np.array([1 + 2j, 3 - 1j]), np.array([0.5 + 1j, -2 + 0j])
    s, t = dense(spark, a), dense(spark, b)
    for op, f in (("add", np.add), ("sub", np.subtract), ("mul", np.multiply), ("div", np.divide)):
        assert np.allclose(s.binary(op, t).to_numpy(), f(a, b))
    assert np.allclose((s - 1.0).to_numpy(), a - 1) and np.allclose((s**2).to_numpy(), a**2)
    assert np.allclose(s.unary("abs").to_numpy(), abs(a)) and np.allclose(s.unary("real").to_numpy(), a.real) and np.allclose(s.unary("angle").to_numpy(), np.angle(a)) and np.allclose(s.unary("exp").to_numpy(), np.exp(a))
    assert s.binary("gt", t).to_numpy().tolist() == (abs(a) > abs(b)).tolist()
    with pytest.raises(Unsupported):
        s.sum()


def test_random(spark):
    u = Tensor.random_uniform(spark, (200, 10), 2, 3, seed=1).to_numpy()
    n = Tensor.random_normal(spark, (200, 10), 1, 2, seed=1).to_numpy()
    assert u.min() >= 2 and u.max() < 3 and abs(u.mean() - 2.5) < 0.05 and abs(n.mean() - 1) < 0.2 and abs(n.std() - 2) < 0.2
    t = Tensor.truncated_normal(spark, (50, 10), 0, 1, seed=2).to_numpy()
    assert abs(t).max() <= 2 and abs(t.mean()) < 0.2
    assert (Tensor.random_uniform(spark, (5,), seed=9).to_numpy() == Tensor.random_uniform(spark, (5,), seed=9).to_numpy()).all()
