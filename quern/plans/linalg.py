"""Matrix decompositions: numpy for one matrix, tasks that take a batch's matrices in stacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..operators import shape as S
from ..operators.tensor import Tensor, xs
from ..schema import TensorSchema
from ..sources.storage import written

#: Cells of a stack of matrices that numpy takes at once.
STACK = 1 << 18


def householder(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, tau) with v[0] = 1 and (I - tau v v^T) x along the first axis."""
    alpha, rest = float(x[0]), float((x[1:] ** 2).sum())
    v = np.array(x, float)
    if rest == 0:
        v[0] = 1.0
        return v, 0.0
    beta = -np.copysign(np.hypot(alpha, np.sqrt(rest)), alpha)
    v /= alpha - beta
    v[0] = 1.0
    return v, float((beta - alpha) / beta)


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q square and orthogonal, R of a's shape, by reflections."""
    n, m = a.shape
    q, r = np.eye(n), np.array(a, float)
    for k in range(min(n - 1, m)):
        v, tau = householder(r[k:, k])
        r[k:] -= tau * np.outer(v, v @ r[k:])
        q[:, k:] -= tau * np.outer(q[:, k:] @ v, v)
    return q, r


def plu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(p, l, u, swaps): p @ l @ u is a, with partial pivoting."""
    n = a.shape[0]
    if a.shape != (n, n):
        raise QueryError("PLU takes a square matrix")
    u, l, order, swaps = np.array(a, float), np.eye(n), np.arange(n), 0
    for k in range(n - 1):
        best = k + int(np.abs(u[k:, k]).argmax())
        if u[best, k] == 0:
            continue
        if best != k:
            u[[k, best]], order[[k, best]], swaps = u[[best, k]], order[[best, k]], swaps + 1
            l[[k, best], :k] = l[[best, k], :k]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    p = np.zeros((n, n))
    p[order, np.arange(n)] = 1
    return p, l, u, swaps


def det(a: np.ndarray) -> float:
    _, _, u, swaps = plu(a)
    return float(np.prod(np.diag(u)) * (-1) ** swaps)


def slogdet(a: np.ndarray) -> tuple[float, float]:
    _, _, u, swaps = plu(a)
    d = np.diag(u)
    if (d == 0).any():
        return 0.0, -np.inf
    return float(np.prod(np.sign(d)) * (-1) ** swaps), float(np.log(np.abs(d)).sum())


def svd(a: np.ndarray, rank: int | None = None, epsilon: float = 1e-12, max_iter: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, s, v) with u @ diag(s) @ v near a, by orthogonal iteration on the smaller Gram matrix."""
    n, m = a.shape
    k = min(n, m) if rank is None else min(rank, n, m)
    if n < m:
        u, s, v = svd(a.T, rank, epsilon, max_iter)
        return v.T, s, u.T
    gram, q = a.T @ a, np.linalg.qr(np.random.default_rng(0).standard_normal((m, m)))[0]
    last = np.full(m, np.inf)
    for _ in range(max_iter):
        q, r = np.linalg.qr(gram @ q)
        now = np.abs(np.diag(r))
        if np.abs(now - last).max() <= epsilon * max(1.0, now.max()):
            break
        last = now
    # a rotation inside near-equal values settles what iteration can't tell apart
    w, e = np.linalg.eigh(q.T @ gram @ q)
    v = (q @ e)[:, ::-1]
    s = np.sqrt(np.maximum(w[::-1], 0))
    u = np.zeros((n, m))
    good = s > s[0] * 1e-12 if s[0] > 0 else np.zeros(m, bool)
    u[:, good] = a @ v[:, good] / s[good]
    return u[:, :k], s[:k], v.T[:k]


def svds(a: np.ndarray, k: int, vectors: bool = True) -> tuple[np.ndarray, ...]:
    """(u, s, v) or (s,) of each matrix of a stack, with vectors of zero for values that vanish, as in ``svd``; NaN where a cell isn't finite."""
    n, m = a.shape[1:]
    bad = ~np.isfinite(a).all((1, 2))
    found = np.linalg.svd(np.where(bad[:, None, None], 0.0, a), full_matrices=False, compute_uv=vectors)
    if not vectors:
        found[bad] = np.nan
        return (found[:, :k],)
    u, s, v = found
    good = (s > s[:, :1] * 1e-12).astype(float)
    u, v = (u * good[:, None, :], v) if n >= m else (u, v * good[:, :, None])
    for x in (u, s, v):
        x[bad] = np.nan
    return u[:, :, :k], s[:, :k], v[:, :k]


def each(fn: Callable[[np.ndarray], tuple]) -> Callable[[np.ndarray], tuple]:
    """A function of one matrix for a stack of them."""
    return lambda stack: tuple(np.stack([np.asarray(x, float) for x in made]) for made in zip(*map(fn, stack)))


def batched(t: Tensor, fn: Callable[[np.ndarray], tuple], *shapes: tuple[int, ...]) -> tuple[Tensor, ...]:
    """Apply ``fn`` to the matrices in the last two axes, a stack at a time; it gives an array for each of ``shapes``, stacked.

    All come from one pass: a row for each matrix holds them, written if there are several. A matrix must fit one task.
    Matrices whose cells were read off arrays are taken from these, where they are (``Tensor.arrays``). Of others the
    cells are dealt out and sorted as plain rows, so that stacks are read off without a list for each matrix.
    """
    lead, (n, m) = t.ndim - 2, t.shape[-2:]
    t = t.to_dense()
    keys = xs(lead) or ["__one"]
    which = F.lit(0).cast("long")
    steps = S.strides(t.shape[:-2])
    for c, step in zip(xs(lead), steps):
        which = which + F.col(c) * step
    most = max(1, STACK // (n * m))
    t_lead = t.shape[:-2]
    per = S.size(t_lead[1:])
    cells = per * n * m

    def results(own, stack):
        for x in range(0, len(own), most):
            part = own[x : x + most]
            at = [part // step for step in steps]
            arrays = [pa.array(i % dim if k else i) for k, (i, dim) in enumerate(zip(at, t_lead))] or [pa.array(part)]
            for f in fn(stack[x : x + most].reshape(-1, n, m)):
                flat = np.ascontiguousarray(f, float).reshape(len(part), -1)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *[f"f{k}" for k in range(len(shapes))]])

    def unpacked(batches):
        for batch in batches:
            rows, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            stack = lists.flatten().to_numpy(zero_copy_only=False)
            ids = (rows[:, None] * per + np.arange(per)).ravel()
            if (counts > cells).any():
                raise QueryError(f"an array has more than {cells} elements")
            if (counts < cells).any():  # what an array lacks is zero, as cells that are not there; a matrix without any is none
                filled = np.zeros((len(rows), cells))
                filled[np.arange(cells) < counts[:, None]] = stack
                some = (np.arange(per) * n * m < counts[:, None]).ravel()
                ids, stack = ids[some], filled.reshape(-1, n * m)[some]
            yield from results(ids, stack.reshape(-1, n * m))

    def run(batches):
        held: list[list] = []

        def made():
            ids, at, v = (np.concatenate(c) for c in zip(*held))
            held.clear()
            own, rank = np.unique(ids, return_inverse=True)
            stack = np.zeros((len(own), n * m))
            stack[rank, at] = v
            yield from results(own, stack)

        for batch in batches:
            if not len(batch):
                continue
            ids, at, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            last = int(np.searchsorted(ids, ids[-1])) if ids[0] != ids[-1] or held and held[-1][0][-1] != ids[0] else 0
            if last or held and held[-1][0][-1] != ids[0]:
                if last:
                    held.append([x[:last].copy() for x in (ids, at, v)])
                yield from made()
            held.append([x[last:].copy() for x in (ids, at, v)])  # the last matrix may go on in the next batch
        if held:
            yield from made()

    spark = t.df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) if lead else 1
    schema = ", ".join([f"{k} long" for k in keys] + [f"f{k} array<double>" for k in range(len(shapes))])
    if t.arrays is not None and lead:
        rows = t.arrays
        few = rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
        out = (rows.repartition(parts, "x0") if few else rows).mapInArrow(unpacked, schema)
        return _factors(out, lead, t_lead, shapes)
    dealt = t.df.select(which.alias("id"), (F.col(f"x{lead}") * m + F.col(f"x{lead + 1}")).cast("int").alias("at"), F.col("v").cast("double").alias("v")).repartition(parts, "id").sortWithinPartitions("id")
    return _factors(dealt.mapInArrow(run, schema), lead, t_lead, shapes)


def _factors(rows: DataFrame, lead: int, extents: tuple[int, ...], shapes: tuple[tuple[int, ...], ...]) -> tuple[Tensor, ...]:
    rows = written(rows, "factors") if len(shapes) > 1 else rows
    return tuple(_factor(rows, xs(lead), f"f{k}", extents, shape) for k, shape in enumerate(shapes))


def _factor(rows: DataFrame, keys: list[str], column: str, lead: tuple[int, ...], shape: tuple[int, ...]) -> Tensor:
    """One array of each row as a tensor's cells."""
    axes = []
    for k in range(len(shape)):
        step = int(np.prod(shape[k + 1 :]))
        axes.append(F.expr(f"CAST(at AS BIGINT) DIV {step} % {shape[k]}").alias(f"x{len(keys) + k}"))
    return Tensor(rows.select(*keys, F.posexplode(column).alias("at", "v")).select(*keys, *axes, "v"), TensorSchema("f64", (*lead, *shape)))


def t_qr(t: Tensor) -> tuple[Tensor, Tensor]:
    n, m = t.shape[-2:]
    return batched(t, each(qr), (n, n), (n, m))


def t_plu(t: Tensor) -> tuple[Tensor, Tensor, Tensor]:
    n = t.shape[-1]
    return batched(t, each(lambda a: plu(a)[:3]), (n, n), (n, n), (n, n))


def t_det(t: Tensor) -> Tensor:
    return batched(t, each(lambda a: ([det(a)],)), (1,))[0]


def t_slogdet(t: Tensor) -> Tensor:
    """The last axis holds sign and logarithm."""
    return batched(t, each(lambda a: (slogdet(a),)), (2,))[0]


def t_svd(t: Tensor, rank: int | None = None) -> tuple[Tensor, Tensor, Tensor]:
    n, m = t.shape[-2:]
    k = min(n, m, rank or n)
    return batched(t, lambda a: svds(a, k), (n, k), (k,), (k, m))


def t_svd_values(t: Tensor, rank: int | None = None) -> Tensor:
    """Without the vectors, so nothing is written."""
    n, m = t.shape[-2:]
    k = min(n, m, rank or n)
    return batched(t, lambda a: svds(a, k, False), (k,))[0]


def t_householder(t: Tensor) -> tuple[Tensor, Tensor]:
    """(v, tau) of each row of a matrix."""
    n = t.shape[-1]
    v, tau = batched(t.expand_dims(t.ndim - 1), each(lambda a: (lambda v, tau: (v, [tau]))(*householder(a[0]))), (n,), (1,))
    return v, tau
