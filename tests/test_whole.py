"""The queries over whole tables against numpy; their SQL is run by test_oracle."""

import duckdb
import numpy as np
import pytest

from quern import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def e():
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    assert [r[0] for r in rows] == list(range(len(rows)))
    return np.array([r[1] for r in rows], float)


def got(spark, name, shape):
    a = np.full(shape, np.nan)
    for r in queries.QUERIES[name](spark, SF).collect():
        a[tuple(r[f"x{i}"] for i in range(len(shape)))] = r["v"]
    return a


def test_products_take_every_row(spark, e):
    m = e.reshape(-1, 8, 8)
    for name, want in (
        ("tensor_matmul", e.T @ e), ("tensor_matmul_blocked", e.T @ e), ("tensor_matmul_batch", m @ m), ("tensor_einsum_ij_jk_ik", e @ (e.T @ e)),
        ("tensor_einsum_ijk_jil_il", np.einsum("ijk,ijl->il", m, m)), ("tensor_product_axis", (1 + e / 8).prod(1)), ("tensor_product_all", (1 + e / e.size).prod()),
    ):
        assert np.allclose(got(spark, name, np.shape(want)), want, rtol=1e-6, atol=1e-3), name


def test_decompositions_take_every_row(spark, e):
    m = e.reshape(-1, 8, 8)
    sign, log = np.linalg.slogdet(m)
    for name, want in (
        ("linalg_qr_reconstruct", m), ("linalg_plu_reconstruct", m), ("linalg_det_large", np.linalg.det(m)[:, None]), ("linalg_slogdet_large", np.stack([sign, log], 1)),
        ("linalg_svd_values_large", np.linalg.svd(m, compute_uv=False)),
    ):
        assert np.allclose(got(spark, name, want.shape), want, rtol=1e-6, atol=1e-3), name


def test_sparse_takes_every_part(spark):
    cells = duckdb.sql(f"SELECT l_partkey, l_suppkey, sum(l_quantity), count(*) FILTER (l_returnflag = 'A') FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    p = np.zeros((max(c[0] for c in cells) + 1, max(c[1] for c in cells) + 1))
    q = np.zeros_like(p)
    for i, j, v, n in cells:
        p[i, j], q[i, j] = v, n
    assert np.allclose(got(spark, "sparse_to_dense", p.shape), p)
    assert np.allclose(np.nan_to_num(got(spark, "sparse_matmul_parts", (len(q), len(q)))), q @ q.T)
