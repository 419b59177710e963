"""Composable operations: named expressions, references, control flow, closures, maps and folds.

An ``Op`` is an ordered list of (name, expression); the last name is its result. Expressions are values, references
(``ref("x")``), calls, control flow, or other ops. Only what the result needs is evaluated, each name once; a
cycle is an error. What an expression gives may be a scalar, a column, a table or a tensor, all of them lazy, so
evaluating an op builds a plan; only conditions of ``While`` and ``If`` that are data are read.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound, QueryError
from ..operators.table import Table
from ..schema import TableSchema
from ..sources.storage import written


class Expr:
    def eval(self, scope: Scope) -> Any:
        raise NotImplementedError

    def __getattr__(self, name: str) -> Method:
        if name.startswith("_"):
            raise AttributeError(name)
        return Method(self, name)

    def __add__(self, other):
        return Call(lambda a, b: a + b, (self, other))

    def __sub__(self, other):
        return Call(lambda a, b: a - b, (self, other))

    def __mul__(self, other):
        return Call(lambda a, b: a * b, (self, other))

    def __lt__(self, other):
        return Call(lambda a, b: a < b, (self, other))

    def __gt__(self, other):
        return Call(lambda a, b: a > b, (self, other))

    def __ge__(self, other):
        return Call(lambda a, b: a >= b, (self, other))

    def __le__(self, other):
        return Call(lambda a, b: a <= b, (self, other))

    def __getitem__(self, key):
        return Call(lambda a, k: a[k], (self, key))


class Scope:
    """Names and the expressions that give them; each is evaluated once, when asked for."""

    def __init__(self, exprs: dict[str, Any], outer: Scope | None = None):
        self.exprs, self.outer, self.done, self.open = exprs, outer, {}, set()

    def get(self, name: str) -> Any:
        if name in self.done:
            return self.done[name]
        if name not in self.exprs:
            if self.outer is None:
                raise NotFound(name)
            return self.outer.get(name)
        if name in self.open:
            raise QueryError(f"{name} depends on itself")
        self.open.add(name)
        self.done[name] = evaluate(self.exprs[name], self)
        self.open.discard(name)
        return self.done[name]


def evaluate(x: Any, scope: Scope) -> Any:
    if isinstance(x, Expr):
        return x.eval(scope)
    if isinstance(x, (list, tuple)):
        return type(x)(evaluate(y, scope) for y in x)
    if isinstance(x, dict):
        return {k: evaluate(v, scope) for k, v in x.items()}
    return x


@dataclass(eq=False)
class Ref(Expr):
    _name: str

    def eval(self, scope):
        return scope.get(self._name)


def ref(name: str) -> Ref:
    return Ref(name)


@dataclass(eq=False)
class Call(Expr):
    _fn: Callable
    _args: tuple = ()
    _kwargs: dict = field(default_factory=dict)

    def eval(self, scope):
        fn = evaluate(self._fn, scope)
        if isinstance(fn, Op):
            return fn.bound(scope)(*evaluate(self._args, scope), **evaluate(self._kwargs, scope))
        return fn(*evaluate(self._args, scope), **evaluate(self._kwargs, scope))


@dataclass(eq=False)
class Method(Expr):
    _of: Any
    _name: str

    def __call__(self, *args, **kwargs) -> Call:
        return Call(lambda of, a, k: getattr(of, self._name)(*a, **k), (self._of, args, kwargs))

    def eval(self, scope):
        return getattr(evaluate(self._of, scope), self._name)


def truth(x: Any) -> bool:
    """A condition that is data is read: one value."""
    if isinstance(x, DataFrame):
        row = x.first()
        return bool(row and row[0])
    if isinstance(x, Column):
        raise QueryError("a column is no condition of control flow; use when()")
    return bool(x)


@dataclass(eq=False)
class If(Expr):
    """Only the branch taken is evaluated; between columns it is F.when."""

    _cond: Any
    _then: Any
    _or_else: Any = None

    def __post_init__(self):
        if isinstance(self._cond, (If, Case)):
            raise QueryError("a condition can't be conditional itself")

    def eval(self, scope):
        cond = evaluate(self._cond, scope)
        if isinstance(cond, Column):
            a, b = evaluate(self._then, scope), evaluate(self._or_else, scope)
            return F.when(cond, a).otherwise(b)
        return evaluate(self._then if truth(cond) else self._or_else, scope)


@dataclass(eq=False)
class Case(Expr):
    """The case of the first equal switch, else the last, which is one more."""

    _on: Any
    _switch: list
    _case: list

    def __post_init__(self):
        if len(self._case) != len(self._switch) + 1:
            raise QueryError("a case for each switch, and a default")

    def eval(self, scope):
        on = evaluate(self._on, scope)
        if isinstance(on, Column):
            out = None
            for s, c in zip(self._switch, self._case):
                s, c = evaluate(s, scope), evaluate(c, scope)
                out = F.when(on == s, c) if out is None else out.when(on == s, c)
            last = evaluate(self._case[-1], scope)
            return last if out is None else out.otherwise(last)
        for s, c in zip(self._switch, self._case):
            if evaluate(s, scope) == on:
                return evaluate(c, scope)
        return evaluate(self._case[-1], scope)


@dataclass(eq=False)
class While(Expr):
    """Repeat ``step`` on a dict of states while ``cond`` holds; both get the states by name.

    Tables among the states are written each ``every`` rounds, so that their plans don't grow with the loop.
    """

    _cond: Callable | Op
    _step: Callable | Op
    _state: dict
    _every: int = 4
    _most: int = 10_000

    def eval(self, scope):
        state = evaluate(self._state, scope)
        cond, step = (f.bound(scope) if isinstance(f, Op) else f for f in (self._cond, self._step))
        for k in range(1, self._most + 1):
            if not truth(cond(**state)):
                return state
            state = step(**state)
            if k % self._every == 0:
                state = {n: written(v, "loop") if isinstance(v, DataFrame) else v for n, v in state.items()}
        raise QueryError("the loop did not end")


@dataclass(eq=False)
class After(Expr):
    _when: Any
    _then: Any

    def eval(self, scope):
        evaluate(self._when, scope)
        return evaluate(self._then, scope)


@dataclass(eq=False)
class With(Expr):
    """A closure: the op with some names of this scope."""

    _capture: list[str]
    _op: Op

    def eval(self, scope):
        return Op(self._op._steps, self._op._params, Scope({n: scope.get(n) for n in self._capture}))


@dataclass(eq=False)
class Op(Expr):
    """A user-defined operation."""

    _steps: list[tuple[str, Any]]
    _params: tuple[str, ...] = ()
    _outer: Scope | None = None

    def bound(self, scope: Scope | None) -> Op:
        return self if self._outer is not None else Op(self._steps, self._params, scope)

    def eval(self, scope):
        return self.bound(scope)

    def __call__(self, *args, **kwargs) -> Any:
        given = dict(zip(self._params, args)) | kwargs
        if missing := [p for p in self._params if p not in given]:
            raise QueryError(f"missing parameters {missing}")
        if not self._steps:
            return None
        return Scope(given | dict(self._steps), self._outer).get(self._steps[-1][0])


class Context:
    """Collects named expressions in order: ``cxt.x = ...``; ``run`` gives the last, or one by name."""

    def __init__(self):
        object.__setattr__(self, "_steps", [])

    def __setattr__(self, name: str, value: Any) -> None:
        if any(n == name for n, _ in self._steps):
            raise QueryError(f"{name} is assigned twice")
        self._steps.append((name, value))

    def __getattr__(self, name: str) -> Ref:
        if not any(n == name for n, _ in self._steps):
            raise AttributeError(name)
        return Ref(name)

    def run(self, name: str | None = None) -> Any:
        return Scope(dict(self._steps)).get(name or self._steps[-1][0])

    def op(self, *params: str) -> Op:
        return Op(list(self._steps), params)


def _verb(name: str):
    def decorate(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args, **kwargs):
            return fn(*args, **kwargs)

        call.verb = name
        return call

    return decorate


get, put, post, delete = map(_verb, ("get", "put", "post", "delete"))


class Library:
    """A named, versioned set of operations; methods with a verb are its routes. Classes inherit as Python's do."""

    name, version = "library", "0.0.0"

    def routes(self) -> dict[str, str]:
        return {n: f.verb for n in dir(type(self)) if callable(f := getattr(type(self), n)) and hasattr(f, "verb")}

    def request(self, verb: str, route: str, **params) -> Any:
        if self.routes().get(route) != verb:
            raise NotFound(f"{verb} {self.name}/{self.version}/{route}")
        return getattr(self, route)(**params)


def reflect(fn: Callable) -> Callable:
    """A method written as operations: what it returns is evaluated with the method's arguments in scope."""

    @functools.wraps(fn)
    def call(self, *args, **kwargs):
        names = list(inspect.signature(fn).parameters)[1:]
        return evaluate(fn(self, *args, **kwargs), Scope({"self": self, **dict(zip(names, args)), **kwargs}))

    call.verb = "post"
    return call


class Instance:
    """A state and the prototype that its attributes and operations come from; what it sets itself hides the prototype's.

    An operation of the prototype is called with the instance's attributes in scope.
    """

    def __init__(self, prototype: dict[str, Any] | Instance, **state):
        self._prototype, self._state = prototype, dict(state)

    def attributes(self) -> dict[str, Any]:
        return (self._prototype.attributes() if isinstance(self._prototype, Instance) else dict(self._prototype)) | self._state

    def get(self, name: str) -> Any:
        found = self.attributes()
        if name not in found:
            raise NotFound(name)
        return found[name]

    def call(self, name: str, **params) -> Any:
        op = self.get(name)
        if not isinstance(op, Op):
            raise QueryError(f"{name} is no operation")
        return op(**{p: params[p] if p in params else self.get(p) for p in op._params})

    def made(self, **state) -> Instance:
        """A new instance whose prototype is this one."""
        return Instance(self, **state)


class Model:
    """Rows of a table as objects: a subclass declares ``key`` and ``values`` as columns, and may add methods.

    ``table`` gives the class's table from a DataFrame, ``of`` a row as an instance, ``saved`` the table with it in.
    """

    key: list[tuple] = []
    values: list[tuple] = []

    def __init__(self, *cells):
        names = self.schema().names
        if len(cells) != len(names):
            raise QueryError(f"the columns are {names}")
        self.__dict__.update(zip(names, cells))

    @classmethod
    def schema(cls) -> TableSchema:
        return TableSchema.of(cls.key, cls.values)

    @classmethod
    def table(cls, df: DataFrame) -> Table:
        return Table.copy_from(cls.schema(), df)

    @classmethod
    def of(cls, table: Table, key: tuple) -> Model:
        row = table.read(key)
        if row is None:
            raise NotFound(key)
        return cls(*[row[c] for c in cls.schema().names])

    def saved(self, table: Table) -> Table:
        names = self.schema()
        cells = lambda columns: tuple(getattr(self, c.name) for c in columns)
        return table.upsert(cells(names.key), cells(names.values))


class Registry:
    def __init__(self):
        self.found: dict[tuple[str, str], Library] = {}

    def install(self, library: Library) -> None:
        if (library.name, library.version) in self.found:
            raise QueryError(f"{library.name} {library.version} is installed")
        self.found[library.name, library.version] = library

    def get(self, name: str, version: str | None = None) -> Library:
        versions = [v for n, v in self.found if n == name]
        if not versions or version and version not in versions:
            raise NotFound(f"{name} {version or ''}")
        return self.found[name, version or max(versions, key=lambda v: tuple(map(int, v.split("."))))]


def map_items(items: list, op: Callable) -> list:
    return [op(x) for x in items]


def for_each(items: list, op: Callable) -> None:
    for x in items:
        op(x)


def fold(items: list, state: Any, op: Callable) -> Any:
    return functools.reduce(op, items, state)
