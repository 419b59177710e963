"""Shape algebra, on the driver."""

from __future__ import annotations

from functools import reduce

from ..errors import QueryError

Shape = tuple[int, ...]


def size(shape: Shape) -> int:
    return reduce(lambda a, b: a * b, shape, 1)


def strides(shape: Shape) -> list[int]:
    return [size(shape[i + 1 :]) for i in range(len(shape))]


def broadcast(a: Shape, b: Shape) -> Shape:
    n = max(len(a), len(b))
    a, b = (1,) * (n - len(a)) + a, (1,) * (n - len(b)) + b
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b)):
        raise QueryError(f"can't broadcast {a} with {b}")
    return tuple(max(x, y) for x, y in zip(a, b))


def axis(i: int, ndim: int) -> int:
    j = i + ndim if i < 0 else i
    if not 0 <= j < ndim:
        raise QueryError(f"no axis {i} among {ndim}")
    return j


def some_axes(axes, ndim: int) -> list[int]:
    """Distinct axes in order; None is all of them."""
    if axes is None:
        return list(range(ndim))
    return sorted({axis(i, ndim) for i in ((axes,) if isinstance(axes, int) else axes)})


def reshape(shape: Shape, to) -> Shape:
    to = tuple(to)
    if any(d is not None and d < 1 for d in to) or sum(d is None for d in to) > 1:
        raise QueryError(f"invalid shape {to}")
    known = size(tuple(d for d in to if d is not None))
    if None in to:
        to = tuple(size(shape) // known if d is None else d for d in to)
    if size(to) != size(shape):
        raise QueryError(f"can't reshape {shape} to {to}")
    return to


def permutation(perm, ndim: int) -> list[int]:
    perm = list(range(ndim))[::-1] if perm is None else [axis(i, ndim) for i in perm]
    if sorted(perm) != list(range(ndim)):
        raise QueryError(f"{perm} is no permutation of {ndim} axes")
    return perm
