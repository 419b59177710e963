"""Einstein summation over coordinate tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import TensorSchema, promote, spark_type
from .shape import size
from .tensor import FLOATS, Tensor


def einsum(spec: str, tensors: list[Tensor]):
    """A tensor, or for an empty right side a one-row DataFrame.

    Labels that are neither in the result nor in another operand are summed away at once, so each step joins the
    smallest operands it can; pairs that share a label go first, those of the smallest result before others.
    """
    left, arrow, out = spec.replace(" ", "").partition("->")
    labels = left.split(",")
    if not arrow or len(labels) != len(tensors):
        raise QueryError(f"invalid einsum {spec}")
    dims: dict[str, int] = {}
    for names, t in zip(labels, tensors):
        if len(names) != t.ndim or len(set(names)) != len(names):
            raise QueryError(f"labels {names} don't fit {t.shape}")
        for n, d in zip(names, t.shape):
            if dims.setdefault(n, d) != d:
                raise QueryError(f"{n} stands for {dims[n]} and {d}")
    if len(set(out)) != len(out) or not set(out) <= set(dims):
        raise QueryError(f"invalid einsum {spec}")
    dtype = promote("i64", *[t.dtype for t in tensors])
    kind = spark_type("f64" if dtype in FLOATS else "i64")
    terms = [(set(n), t.df.select(*[F.col(f"x{i}").alias(f"_{c}") for i, c in enumerate(n)], F.col("v").cast(kind).alias("v"))) for n, t in zip(labels, tensors)]

    def reduced(term, others):
        have, df = term
        needed = have & (set(out) | {c for names, _ in others for c in names})
        if needed == have:
            return term
        return needed, df.groupBy(*[f"_{c}" for c in sorted(needed)]).agg(F.sum("v").cast(kind).alias("v"))

    terms = [reduced(t, terms[:i] + terms[i + 1 :]) for i, t in enumerate(terms)]
    while len(terms) > 1:
        cost = lambda a, b: (not a & b, size(tuple(dims[c] for c in a | b)))
        i, j = min(((i, j) for i in range(len(terms)) for j in range(i + 1, len(terms))), key=lambda p: cost(terms[p[0]][0], terms[p[1]][0]))
        (a, l), (b, r) = terms[i], terms[j]
        on = sorted(a & b)
        if on:
            pair = l.withColumnRenamed("v", "l").join(r.withColumnRenamed("v", "r"), [f"_{c}" for c in on])
        else:  # an outer product: its size is the result's
            pair = l.withColumnRenamed("v", "l").crossJoin(r.withColumnRenamed("v", "r"))
        pair = pair.select(*[f"_{c}" for c in sorted(a | b)], (F.col("l") * F.col("r")).alias("v"))
        rest = [t for k, t in enumerate(terms) if k not in (i, j)]
        terms = [*rest, reduced((a | b, pair), rest)]
    have, df = terms[0]
    if not out:
        return df.agg(F.coalesce(F.sum("v").cast(kind), F.lit(0).cast(kind)).alias("v"))
    sparse = any(t.sparse for t in tensors)
    t = Tensor(df.select(*[F.col(f"_{c}").alias(f"x{i}") for i, c in enumerate(out)], F.col("v").cast(spark_type(dtype)).alias("v")), TensorSchema(dtype, tuple(dims[c] for c in out)), sparse)
    return t._nonzero() if sparse else t
