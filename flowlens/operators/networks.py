"""Small networks trained by gradients that Spark sums over partitions.

A round sends the parameters to the tasks, each task adds up the gradient of its rows, block by block, and the sums meet in
a tree of additions; the driver takes an Adam step. Parameters are a few thousand numbers, whatever the number of rows; the
training rows are written once, as blocks that executors hold between the rounds.

* :class:`AttentionNet` - a window of rows in their order: rows are embedded with a place of their own, each attends to all
  others, and the sequence as it stands (not a pool of it) goes into the output layer.
* :class:`Autoencoder` - features through a bottleneck and back, linear maps and tanh layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .blocks import HELD, blocks


class _Net:
    """Parameters as one vector, cut into named arrays."""

    def shapes(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def start(self, seed: int) -> np.ndarray:
        """Scaled normal weights, zero biases (names that begin with b)."""
        rng = np.random.default_rng(seed)
        return np.concatenate([np.zeros(int(np.prod(s))) if name.startswith("b") else
                               rng.normal(0, 1 / np.sqrt(s[0]), s).ravel() for name, s in self.shapes().items()])

    def parts(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.shapes().items():
            n = int(np.prod(s))
            out[name] = theta[at:at + n].reshape(s)
            at += n
        return out

    def flat(self, grads: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([grads[name].ravel() for name in self.shapes()])


@dataclass(frozen=True)
class AttentionNet(_Net):
    length: int
    features: int
    width: int = 16
    hidden: int = 16

    @property
    def inputs(self) -> int:
        return self.length * self.features

    def shapes(self):
        d, t = self.width, self.length
        return {"wx": (self.features, d), "place": (t, d), "wq": (d, d), "wk": (d, d), "wv": (d, d),
                "w1": (t * d, self.hidden), "b1": (self.hidden,), "w2": (self.hidden,), "b2": (1,)}

    def _forward(self, p, x):
        x = x.reshape(len(x), self.length, self.features)
        e = x @ p["wx"] + p["place"]
        q, k, v = e @ p["wq"], e @ p["wk"], e @ p["wv"]
        s = q @ k.transpose(0, 2, 1) / np.sqrt(self.width)
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        h = (e + a @ v).reshape(len(x), -1)
        u = np.tanh(h @ p["w1"] + p["b1"])
        return x, e, q, k, v, a, h, u, u @ p["w2"] + p["b2"]

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self._forward(self.parts(theta), x)[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the weighted log losses, and its gradient."""
        p = self.parts(theta)
        x, e, q, k, v, a, h, u, z = self._forward(p, x)
        prob = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        loss = -(w * (y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12))).sum()
        dz = w * (prob - y)
        du = np.outer(dz, p["w2"]) * (1 - u * u)
        de = (du @ p["w1"].T).reshape(e.shape)
        da, dv = de @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ de
        ds = a * (da - (da * a).sum(axis=2, keepdims=True)) / np.sqrt(self.width)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        de = de + dq @ p["wq"].T + dk @ p["wk"].T + dv @ p["wv"].T
        d = self.width
        rows = lambda m: m.reshape(-1, m.shape[2])
        left = rows(e).T
        return float(loss), self.flat({
            "wx": rows(x).T @ rows(de), "place": de.sum(axis=0), "wq": left @ dq.reshape(-1, d), "wk": left @ dk.reshape(-1, d),
            "wv": left @ dv.reshape(-1, d), "w1": h.T @ du, "b1": du.sum(axis=0), "w2": u.T @ dz, "b2": np.array([dz.sum()])})


@dataclass(frozen=True)
class Autoencoder(_Net):
    """Code and reconstruction are each a linear map and a tanh layer added to it; from principal components as the linear
    maps, with the layers' outputs zero, training starts at the linear reconstruction and goes on from there."""

    features: int
    hidden: int = 32
    bottleneck: int = 12

    @property
    def inputs(self) -> int:
        return self.features

    def shapes(self):
        f, h, k = self.features, self.hidden, self.bottleneck
        return {"we": (f, k), "w0": (f, h), "b0": (h,), "w1": (h, k), "wd": (k, f), "w2": (k, h), "b2": (h,), "w3": (h, f), "b3": (f,)}

    def from_components(self, components: np.ndarray, seed: int) -> np.ndarray:
        p = self.parts(self.start(seed))
        return self.flat({**p, "we": components.T, "wd": components, "w1": 0 * p["w1"], "w3": 0 * p["w3"]})

    def _forward(self, p, x):
        u = np.tanh(x @ p["w0"] + p["b0"])
        z = x @ p["we"] + u @ p["w1"]
        s = np.tanh(z @ p["w2"] + p["b2"])
        return u, z, s, z @ p["wd"] + s @ p["w3"] + p["b3"]

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Mean squared error of each row's reconstruction."""
        return ((self._forward(self.parts(theta), x)[-1] - x) ** 2).mean(axis=1)

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the weighted errors, and its gradient."""
        p = self.parts(theta)
        u, z, s, out = self._forward(p, x)
        off = out - x
        d = 2 * w[:, None] * off / self.features
        ds = (d @ p["w3"].T) * (1 - s * s)
        dz = d @ p["wd"].T + ds @ p["w2"].T
        du = (dz @ p["w1"].T) * (1 - u * u)
        return float((w * (off * off).mean(axis=1)).sum()), self.flat({
            "we": x.T @ dz, "w0": x.T @ du, "b0": du.sum(axis=0), "w1": u.T @ dz, "wd": z.T @ d, "w2": z.T @ ds,
            "b2": ds.sum(axis=0), "w3": s.T @ d, "b3": d.sum(axis=0)})


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_network(net: _Net, data: DataFrame, rounds: int = 100, step: float = 0.01, seed: int = 42,
                theta: np.ndarray | None = None) -> np.ndarray:
    """``data(x array<double>, y double, w double)`` -> parameters after ``rounds`` Adam steps on the mean weighted loss,
    from ``theta`` or a random start."""
    spark = data.sparkSession
    ship_package(spark)

    def convert(b) -> tuple:
        return (_matrix(b.column(0)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))

    rows = blocks(data.select("x", "y", "w"), convert, 8 * (net.inputs + 2), "network-rows").persist(HELD)
    total = rows.map(lambda b: float(np.nansum(b[2]))).sum()
    theta = net.start(seed) if theta is None else theta
    if not total:
        return theta
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(theta)

        def run(found: Iterator[tuple], shared=shared) -> Iterator[np.ndarray]:
            acc = np.zeros(net.size)
            for x, y, w in found:
                acc += net.gradient(shared.value, x, y, w)[1]
            yield acc

        g = rows.mapPartitions(run).treeReduce(np.add) / total
        shared.unpersist()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - step * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.999 ** r)) + 1e-8)
    rows.unpersist()
    return theta


def predict_column(df: DataFrame, net: _Net, theta: np.ndarray, x: str, out: str) -> DataFrame:
    """``df`` with ``out``, the network's output for the array column ``x``; scored per Arrow batch."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(theta)  # net.size numbers
    at, names = df.columns.index(x), [*df.columns, out]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = net.predict(shared.value, _matrix(b.column(at))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
