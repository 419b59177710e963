"""Steps whose memory, disk or time must not grow faster than their input."""

import numpy as np

from quern.operators.tensor import STRETCH, Tensor
from quern.plans import autodiff as ad

A = np.array([[3.0, -1.0, 3.0], [2.0, 5.0, 4.0]])


def dense(spark, a) -> Tensor:
    return Tensor.load(spark, a.shape, a.ravel().tolist())


def plan(t: Tensor) -> str:
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_not_made_tensors(spark):
    t = dense(spark, A)
    for made, want in ((t.cond(1.0, 0.0), (A != 0) * 1.0), (t.of_number("sub", 1.0), 1 - A)):
        assert "Join" not in plan(made) and "Generate" not in plan(made)
        assert np.allclose(made.to_numpy(), want)
    x = ad.var("x", A.shape)
    largest = ad.tensor(ad.gradients(x.max(1).sum(), ["x"])["x"], {"x": t})
    assert "Generate" not in plan(largest)  # nothing is repeated for a join
    assert np.allclose(largest.to_numpy(), [[0.5, 0, 0.5], [0, 1, 0]])
    narrow = ad.tensor(ad.cond(x.compare("gt", 2.0), x * x.sum((1,), True), -x), {"x": t})
    assert np.allclose(narrow.to_numpy(), np.where(A > 2, A * A.sum(1, keepdims=True), -A))


def test_conditions_join_on_shared_axes(spark):
    row, col = np.array([[0.0, 1.0, 0.0]]), np.array([[7.0], [8.0]])
    got = dense(spark, row).cond(dense(spark, A), dense(spark, col))
    assert got.shape == A.shape and np.allclose(got.to_numpy(), np.where(row, A, col))
    assert np.allclose(dense(spark, row).cond(2, dense(spark, col)).to_numpy(), np.where(row, 2, np.broadcast_to(col, A.shape)))


def test_few_rows_are_stretched_by_all_tasks(spark):
    wide = Tensor.constant(spark, (1, 1), 2.0).broadcast((STRETCH + 5, 3))
    assert wide.df.rdd.getNumPartitions() > 1
    assert wide.df.distinct().count() == 3 * (STRETCH + 5) and wide.df.agg({"x0": "max", "v": "sum"}).first()["max(x0)"] == STRETCH + 4
    many = Tensor.arange(spark, (STRETCH + 1, 1), 0, STRETCH + 1).broadcast((STRETCH + 1, 2))
    assert many.df.distinct().count() == 2 * (STRETCH + 1)


def test_gradient_of_squares_is_a_projection(spark):
    x = ad.var("x", A.shape)
    made = ad.tensor(ad.gradients((x**2.0).sum(), ["x"])["x"], {"x": dense(spark, A)})
    assert "Join" not in plan(made) and "Generate" not in plan(made)
    assert np.allclose(made.to_numpy(), 2 * A)
    assert np.allclose(ad.tensor(ad.gradients(x.sum(), ["x"])["x"], {"x": dense(spark, A)}).to_numpy(), np.ones(A.shape))


def test_zeros_are_filled_in_where_the_cells_are(spark):
    from quern.operators.tensor import GAP

    cells = {(0, 0, 0): 1.0, (0, 1, 3): -2.0, (1, 0, GAP - 1): 3.0, (1, 1, 2): 4.0, (1, 1, GAP): 5.0}
    t = Tensor.load(spark, (2, 2, GAP + 1), list(cells.items()), "f64").to_dense()
    text = plan(t)
    assert "Join" not in text and "Range (0, 5," in text  # a row for each block is dealt out, not one for each cell
    assert t.df.distinct().count() == t.df.count() == t.size
    assert {tuple(r)[:3]: r["v"] for r in t.df.where("v <> 0").collect()} == cells
    assert t.df.where("x0 < 0 OR x0 > 1 OR x1 < 0 OR x1 > 1 OR x2 < 0").count() == 0
    assert np.array_equal(Tensor.zeros(spark, (2, 3), sparse=True).to_dense().to_numpy(), np.zeros((2, 3)))
    assert np.array_equal(Tensor.load(spark, (2, 2), [((0, 1), 1 + 2j)]).to_dense().to_numpy(), [[0, 1 + 2j], [0, 0]])


def test_sparse_products_are_added_up_in_tiles(spark, monkeypatch):
    from quern.operators import block

    rng = np.random.default_rng(5)
    a = np.where(rng.random((90, 70)) < 0.2, rng.integers(-3, 4, (90, 70)), 0).astype(float)
    b = np.where(rng.random((70, 50)) < 0.2, rng.integers(-3, 4, (70, 50)), 0).astype(float)
    a[7], b[:, 11], a[20:30], b[5] = 2.0, -1.0, 0, 0
    sparse = lambda m: Tensor.load(spark, m.shape, [((int(i), int(j)), float(m[i, j])) for i, j in zip(*m.nonzero())], "f64")
    monkeypatch.setattr(block, "JOINED", 100)
    monkeypatch.setattr("quern.operators.tensor.JOINED", 100)
    for band, held in ((60, 1), (200, 40), (10_000, 1 << 20)):
        monkeypatch.setattr(block, "BAND", band)
        monkeypatch.setattr(block, "PRODUCTS", held)
        got = sparse(a) @ sparse(b)
        assert "Join" in plan(got) and "MapInArrow" in plan(got) and "Aggregate [i" not in plan(got)  # products aren't dealt out
        rows = got.df.collect()
        assert len(rows) == len({(r.x0, r.x1) for r in rows}) == np.count_nonzero(a @ b)
        assert np.array_equal(got.to_numpy(), a @ b)


def test_zeros_are_filled_in_down_the_columns(spark, monkeypatch):
    """A file's dictionaries hold few values of long axes: the last coordinate stays for a whole column of a block."""
    monkeypatch.setattr("quern.operators.tensor.GAP", 64)
    monkeypatch.setattr("quern.operators.tensor.TALL", 16, raising=False)
    rng = np.random.default_rng(3)
    for shape in ((33, 50), (5, 7, 40), (150,), (3, 200), (700, 2), (1, 1), (64, 1)):
        a = np.where(rng.random(shape) < 0.1, rng.integers(1, 9, shape), 0).astype(float)
        cells = [(tuple(map(int, i)), float(a[tuple(i)])) for i in np.argwhere(a)] or [((0,) * a.ndim, 0.0)]
        t = Tensor.load(spark, shape, cells, "f64").to_dense()
        parts = t.df.rdd.glom().collect()
        assert sum(map(len, parts)) == a.size == len({tuple(r)[:-1] for p in parts for r in p})
        assert all(a[tuple(r)[:-1]] == r.v for p in parts for r in p)
        if shape == (33, 50):
            changes = sum(x.x1 != y.x1 for p in parts for x, y in zip(p, p[1:]))
            assert changes <= a.size / 11  # 33 rows in three bands


def test_a_file_of_a_sparse_product_has_few_columns(spark, monkeypatch):
    from quern.operators import block

    rng = np.random.default_rng(6)
    a, b = (np.where(rng.random(shape) < 0.3, rng.integers(1, 4, shape), 0).astype(float) for shape in ((60, 40), (40, 90)))
    sparse = lambda m: Tensor.load(spark, m.shape, [((int(i), int(j)), float(m[i, j])) for i, j in zip(*m.nonzero())], "f64")
    monkeypatch.setattr("quern.operators.tensor.JOINED", 100)
    for name, n in (("JOINED", 100), ("BAND", 300), ("PRODUCTS", 1000), ("STRIP", 8)):
        monkeypatch.setattr(block, name, n, raising=False)
    parts = (sparse(a) @ sparse(b)).df.rdd.glom().collect()
    assert max(len({r.x1 for r in p}) for p in parts) <= 8
    assert {(r.x0, r.x1): r.v for p in parts for r in p} == {(int(i), int(j)): (a @ b)[i, j] for i, j in zip(*(a @ b).nonzero())}
    assert sum(map(len, parts)) == np.count_nonzero(a @ b)
