"""Small neural networks: parameters on the driver, gradients added up on the executors.

A model's loss for a batch is an ``autodiff`` graph; each partition evaluates its gradient on numpy batches, and the
sums by parameter come from an aggregation with map-side partials, so the driver gets one number for each parameter
whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from . import autodiff as ad

ACTIVATIONS: dict[str, Callable] = {"identity": lambda x: x, "sigmoid": ad.sigmoid, "tanh": ad.tanh, "relu": ad.relu, "softmax": ad.softmax}


@dataclass
class Linear:
    name: str
    inputs: int
    outputs: int
    activation: str = "identity"

    def parameters(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        return {f"{self.name}.w": rng.standard_normal((self.inputs, self.outputs)) / np.sqrt(self.inputs), f"{self.name}.b": np.zeros(self.outputs)}

    def forward(self, x: ad.Node) -> ad.Node:
        w, b = ad.var(f"{self.name}.w", (self.inputs, self.outputs)), ad.var(f"{self.name}.b", (self.outputs,))
        return ACTIVATIONS[self.activation](x @ w + b)


@dataclass
class Conv:
    """A convolution over images of rows channels x height x width, by im2col: a selection matrix, then ``Linear``."""

    name: str
    channels: int
    height: int
    width: int
    filters: int
    kernel: int
    stride: int = 1
    padding: int = 0
    activation: str = "identity"

    @property
    def out(self) -> tuple[int, int]:
        f = lambda d: (d + 2 * self.padding - self.kernel) // self.stride + 1
        return f(self.height), f(self.width)

    def columns(self) -> np.ndarray:
        """Place of the input cell of each (position, patch cell); -1 in the padding."""
        at = np.pad(np.arange(self.channels * self.height * self.width).reshape(self.channels, self.height, self.width), ((0, 0), *[(self.padding, self.padding)] * 2), constant_values=-1)
        h, w = self.out
        return np.stack([at[:, i * self.stride : i * self.stride + self.kernel, j * self.stride : j * self.stride + self.kernel].ravel() for i in range(h) for j in range(w)])

    def parameters(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        n = self.channels * self.kernel**2
        return {f"{self.name}.w": rng.standard_normal((n, self.filters)) / np.sqrt(n), f"{self.name}.b": np.zeros(self.filters)}

    def forward(self, x: ad.Node) -> ad.Node:
        """rows x cells to rows x (positions * filters)."""
        rows, (h, w) = x.shape[0], self.out
        at = self.columns()
        pick = np.zeros((x.shape[1], at.size))
        inside = at.ravel() >= 0
        pick[at.ravel()[inside], np.flatnonzero(inside)] = 1
        patches = (x @ ad.wrap(pick)).reshape((rows * h * w, at.shape[1]))
        weights, bias = ad.var(f"{self.name}.w", (at.shape[1], self.filters)), ad.var(f"{self.name}.b", (self.filters,))
        return ACTIVATIONS[self.activation](patches @ weights + bias).reshape((rows, h * w * self.filters))


@dataclass
class Sequential:
    layers: list

    def parameters(self, seed: int = 0) -> dict[str, np.ndarray]:
        rng, out = np.random.default_rng(seed), {}
        for layer in self.layers:
            made = layer.parameters(rng)
            if set(made) & set(out):
                raise QueryError("two layers have one name")
            out |= made
        return out

    def forward(self, x: ad.Node) -> ad.Node:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def predict(self, params: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        return ad.numpy(self.forward(ad.var("x", x.shape)), params | {"x": x})


def dnn(sizes: list[int], activation: str = "sigmoid") -> Sequential:
    return Sequential([Linear(f"l{i}", a, b, activation) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))])


def squared(y: ad.Node, t: ad.Node) -> ad.Node:
    return ((y - t) ** 2.0).sum()


@dataclass
class GradientDescent:
    rate: float = 0.01

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {k: v - self.rate * grads[k] for k, v in params.items()}


@dataclass
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    i: int = 0
    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.i += 1
        out = {}
        for k, p in params.items():
            self.m[k] = self.beta1 * self.m.get(k, 0) + (1 - self.beta1) * grads[k]
            self.v[k] = self.beta2 * self.v.get(k, 0) + (1 - self.beta2) * grads[k] ** 2
            out[k] = p - self.rate * (self.m[k] / (1 - self.beta1**self.i)) / (np.sqrt(self.v[k] / (1 - self.beta2**self.i)) + self.epsilon)
        return out


def gradient(model: Sequential, params: dict[str, np.ndarray], df: DataFrame, features: str, target: str, loss: Callable = squared, batch: int = 1024) -> tuple[dict[str, np.ndarray], float]:
    """Mean gradient and mean loss over a table of (array, array)."""
    names = list(params)
    ends = np.cumsum([0] + [params[k].size for k in names])

    def run(batches):
        total, lost, rows = np.zeros(ends[-1]), 0.0, 0
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                n = part.num_rows
                x, t = (np.asarray(part.column(k).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) for k in (0, 1))
                graph = loss(model.forward(ad.var("x", x.shape)), ad.var("t", t.shape))
                env = params | {"x": x, "t": t}
                grads = ad.gradients(graph, names)
                total += np.concatenate([np.broadcast_to(ad.numpy(grads[k], env), params[k].shape).ravel() for k in names])
                lost += float(ad.numpy(graph, env))
                rows += n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(total))), pa.array(np.concatenate([[rows, lost], total]))], names=["at", "v"])

    sums = df.select(features, target).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(ends[-1] + 2)
    for r in sums:
        flat[r["at"] + 2] = r["v"]
    n = max(1.0, flat[0])
    return {k: flat[2 + a : 2 + b].reshape(params[k].shape) / n for k, a, b in zip(names, ends, ends[1:])}, flat[1] / n


def train(model: Sequential, df: DataFrame, features: str, target: str, optimizer, steps: int, params: dict[str, np.ndarray] | None = None, loss: Callable = squared) -> tuple[dict[str, np.ndarray], list[float]]:
    """Full-batch steps; the parameters and the loss before each step."""
    params, losses = params or model.parameters(), []
    for _ in range(steps):
        grads, lost = gradient(model, params, df, features, target, loss)
        params = optimizer.step(params, grads)
        losses.append(lost)
    return params, losses
