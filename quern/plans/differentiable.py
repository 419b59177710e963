"""Functions that can be called on values, columns or tensors, put into one another, and derived.

``differentiable`` traces a Python function of graphs once; what it gives is a ``Function``. A ``StateFunction`` also has
parameters with values, which ``step`` moves against a gradient.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column

from ..errors import QueryError
from ..operators.tensor import Tensor
from . import autodiff as ad


@dataclass(frozen=True)
class Function:
    """A graph and the names and shapes of its arguments, in order."""

    arguments: tuple[tuple[str, tuple[int, ...]], ...]
    graph: ad.Node

    def _bound(self, args: tuple, named: dict) -> dict[str, Any]:
        names = [n for n, _ in self.arguments]
        found = dict(zip(names, args)) | named
        if len(args) > len(names) or set(found) != set(names):
            raise QueryError(f"the arguments are {names}")
        return found

    def __call__(self, *args, **named):
        """On graphs it composes; on columns it gives a column, on tensors a tensor, on numbers and arrays an array."""
        found = self._bound(args, named)
        if any(isinstance(v, ad.Node) for v in found.values()):
            return ad.substitute(self.graph, {k: ad.wrap(v) for k, v in found.items()})
        if any(isinstance(v, Column) for v in found.values()):
            return ad.column(self.graph, found)
        return ad.tensor(self.graph, found) if any(isinstance(v, Tensor) for v in found.values()) else ad.numpy(self.graph, found)

    def derivative(self, name: str | None = None) -> Function:
        """Of the sum of the result, by one argument (the first, if none is named); a function of the same arguments."""
        name = name or self.arguments[0][0]
        return replace(self, graph=ad.gradients(self.graph, [name])[name])

    def of(self, **inner: Function) -> Function:
        """Functions in the place of arguments; arguments of one name are one."""
        graph = ad.substitute(self.graph, {k: f.graph for k, f in inner.items()})
        rest = [a for a in self.arguments if a[0] not in inner] + [a for f in inner.values() for a in f.arguments]
        return Function(tuple(dict(rest).items()), graph)


@dataclass(frozen=True)
class StateFunction(Function):
    """A function some of whose arguments are parameters with values."""

    state: tuple[tuple[str, Any], ...] = ()

    def _bound(self, args: tuple, named: dict) -> dict[str, Any]:
        held = dict(self.state)
        free = Function(tuple(a for a in self.arguments if a[0] not in held), self.graph)
        return free._bound(args, {k: v for k, v in named.items() if k not in held}) | held | {k: v for k, v in named.items() if k in held}

    def gradients(self, *args, **named) -> dict[str, np.ndarray]:
        """Of the sum of the result, by each parameter."""
        found, names = self._bound(args, named), [k for k, _ in self.state]
        return {k: np.broadcast_to(ad.numpy(g, found), np.shape(dict(self.state)[k])) for k, g in ad.gradients(self.graph, names).items()}

    def step(self, rate: float, *args, **named) -> StateFunction:
        """With the parameters moved against the gradient."""
        g = self.gradients(*args, **named)
        return replace(self, state=tuple((k, v - rate * g[k]) for k, v in self.state))


def differentiable(*shapes: tuple[int, ...], **state) -> Callable[[Callable], Function]:
    """Decorator: ``shapes`` of the arguments in order (scalars, where none is given); ``state``: values of parameters."""

    def trace(fn: Callable) -> Function:
        names = list(inspect.signature(fn).parameters)
        full = {n: np.shape(state[n]) if n in state else s for n, s in zip(names, [*shapes, *[()] * len(names)])}
        graph = ad.wrap(fn(*[ad.var(n, s) for n, s in full.items()]))
        return StateFunction(tuple(full.items()), graph, tuple(state.items())) if state else Function(tuple(full.items()), graph)

    return trace
