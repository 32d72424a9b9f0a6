"""Boosted trees with second-order gains (M8): histograms of gradients that Spark sums level by level.

Features become quantile bins once, and rows blocks that executors hold. A round grows one tree over its own share of the
rows and of the columns: for each level, every task adds up (gradient, curvature) by node, column and bin over its blocks, and
the sums of all tasks meet by node, where the best cut is picked. What reaches the driver in a level is a cut for each node,
whatever the number of rows. The blocks of a round hold the margins after the trees before it, so a level walks its own tree
only; every ``KEEP`` rounds they are written, as a start for a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES, LABEL
from ..session import ensure_checkpoint_dir, materialised, ship_package
from .blocks import HELD, blocks
from .dataset import class_weights

#: Rounds after which the blocks are written anew.
KEEP = 25


@dataclass(frozen=True)
class BoostedModel:
    """Trees as (node, column or -1, cut, value, gain) rows; node n has the children 2n + 1 (value <= cut) and 2n + 2."""
    features: tuple[str, ...]
    depth: int
    trees: tuple[tuple[tuple[int, int, float, float, float], ...], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for tree in self.trees:
            feature, cut, value = _arrays(tree, self.depth)
            margin += value[_walk(x, feature, cut, self.depth)]
        return _sigmoid(margin)

    def importances(self) -> dict[str, float]:
        """Mean gain of a column's cuts, as shares."""
        gain, cuts = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            for _, f, _, _, g in tree:
                if f >= 0:
                    gain[f] += g
                    cuts[f] += 1
        mean = gain / np.maximum(cuts, 1)
        return dict(zip(self.features, (mean / (mean.sum() or 1.0)).tolist()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _arrays(tree, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    for node, f, c, v, _ in tree:
        feature[node], cut[node], value[node] = f, c, v
    return feature, cut, value


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row comes to within so many levels."""
    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[row, np.maximum(f, 0)] > cut[node]), node)
    return node


def _draw(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id and salt."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD1B54A32D192ED03 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def _columns(batch, names) -> np.ndarray:
    """Rows x columns; null and NaN as 0."""
    x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in names])
    return np.where(np.isnan(x), 0.0, x)


def _binned(data: DataFrame, features: tuple[str, ...], cuts: list[np.ndarray]) -> RDD:
    """Blocks (ids, bins of a column in a row, label, weight, margin)."""
    def convert(b) -> tuple:
        x = _columns(b, features)
        bins = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)
        return (b.column("id").to_numpy(), bins, *(b.column(k).to_numpy() for k in ("y", "w")))

    found = blocks(data, convert, len(features) + 32, "boost-rows")
    return found.map(lambda b: (b[0], np.ascontiguousarray(b[1].T), b[2], b[3], np.zeros(len(b[0]))))


def _advanced(block: tuple, tree: tuple, depth: int) -> tuple:
    """The block with the margins after ``tree``."""
    feature, cut, value = tree
    return (*block[:4], block[4] + value[_walk(block[1].T, feature, cut, depth)])


def _sums(block: tuple, tree: tuple, level: int, at: np.ndarray, count: int, columns: np.ndarray, bins: int, share: float,
          salt: int, sums: np.ndarray) -> np.ndarray:
    """Adds the block's rows to ``sums`` (node, column, bin, gradient and curvature); which of the level's nodes it has met."""
    ids, x, y, w, margin = block
    here = at[_walk(x.T, tree[0], tree[1], level)]
    use = here >= 0
    if share < 1:
        use &= _draw(ids, salt) < share
    met = np.zeros(count, bool)
    here, y, w, p = here[use], y[use], w[use], _sigmoid(margin[use])
    met[here] = True
    first, gradient, curvature = here * bins, w * (p - y), w * p * (1 - p)
    for j, f in enumerate(columns):
        cell = first + x[f][use]
        for k, g in enumerate((gradient, curvature)):
            sums[:, j, :, k] += np.bincount(cell, g, count * bins).reshape(count, bins)
    return met


def _level(rows: RDD, tree: tuple, level: int, depth: int, nodes: list[int], columns: np.ndarray, bins: int, share: float,
           salt: int, reg_lambda: float, min_weight: float) -> dict[int, tuple]:
    """Per node of the level that has rows: its sums of gradient and curvature, and its best cut."""
    at = np.full(2 ** (depth + 1) - 1, -1)
    at[nodes] = np.arange(len(nodes))

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        sums = np.zeros((len(nodes), len(columns), bins, 2))
        met = np.zeros(len(nodes), bool)
        for b in found:
            met |= _sums(b, tree, level, at, len(nodes), columns, bins, share, salt, sums)
        for i in np.flatnonzero(met).tolist():
            yield nodes[i], sums[i]

    def cut(s: np.ndarray) -> tuple:
        return s[0].sum(axis=0), _best_cut(s, reg_lambda, min_weight)

    total = rows.mapPartitions(run).reduceByKey(np.add, min(len(nodes), rows.context.defaultParallelism))
    return dict(total.mapValues(cut).collect())  # a cut for each node


def _best_cut(sums: np.ndarray, reg_lambda: float, min_weight: float):
    """(gain, column, bin, left sums, right sums) of the best cut, first of ties; None where no cut gains."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left

    def worth(s):
        h = s[..., 1] + reg_lambda
        return np.divide(s[..., 0] ** 2, h, out=np.zeros_like(h), where=h > 1e-12)

    gain = worth(left) + worth(right) - worth(whole)
    gain = np.where((left[..., 1] >= min_weight) & (right[..., 1] >= min_weight), gain, -np.inf)
    if not gain.size or gain.max() <= 1e-9:
        return None
    # sums of different tasks meet in any order: gains that differ in the last bits are ties
    f, b = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-12))), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def _leaf(s: np.ndarray, reg_lambda: float, step: float) -> float:
    return float(-step * s[0] / (s[1] + reg_lambda)) if s[1] + reg_lambda > 1e-12 else 0.0


def train_boosted(train: DataFrame, rounds: int = 400, depth: int = 7, step: float = 0.05, subsample: float = 0.9,
                  column_share: float = 0.9, reg_lambda: float = 1.0, min_weight: float = 2.0, bins: int = 64, seed: int = 42,
                  features: tuple[str, ...] = tuple(FEATURES), balanced: bool = True) -> BoostedModel:
    """Log-loss boosting with an L2 term on leaf values; each tree has its own share of columns and of rows.

    ``min_weight`` is the least curvature of a side of a cut; ``balanced`` weighs attacks as much as the rest. Null and NaN
    features count as 0, rows without a label take no part; no rows give a model without trees, which scores 0.5. ``bins``
    is at most 256. Row shares are drawn by row, so repeated rows don't go together.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    spark = train.sparkSession
    ship_package(spark)
    features = tuple(features)
    heavy = class_weights(train).first()["scale_pos_weight"] if balanced else 1.0
    clean = [F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    data = train.where(F.col(LABEL).isNotNull()).select(
        *clean, F.monotonically_increasing_id().alias("id"), F.col(LABEL).cast("double").alias("y"),
        F.when(F.col(LABEL) == 1, F.lit(float(heavy or 1.0))).otherwise(F.lit(1.0)).alias("w"))
    data = materialised(data, "boost-input")
    found = data.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.25 / bins)
    if not found or not found[0]:
        return BoostedModel(features, depth, ())
    cuts = [np.unique(c) for c in found]
    ensure_checkpoint_dir(spark)
    rows, before = _binned(data, features, cuts).persist(HELD), None
    width, rng = len(features), np.random.default_rng(seed)
    trees = []
    for r in range(rounds):
        columns = np.sort(rng.choice(width, max(1, round(column_share * width)), replace=False))
        tree, grown = (np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)), {}
        nodes = [0]
        for level in range(depth):
            found = _level(rows, tree, level, depth, nodes, columns, bins, subsample, seed * 1_000_003 + r, reg_lambda, min_weight)
            if before is not None:  # the blocks of this round are there
                before.unpersist()
                before = None
            if level == 0 and 0 in found:
                grown[0] = (-1, 0.0, _leaf(found[0][0], reg_lambda, step), 0.0)
            nodes = []
            for node in sorted(found):
                best = found[node][1]
                if best is None:
                    continue
                gain, j, b, left, right = best
                f = int(columns[j])
                tree[0][node], tree[1][node] = f, b
                grown[node] = (f, b, 0.0, gain)
                for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                    grown[child] = (-1, 0.0, _leaf(s, reg_lambda, step), 0.0)
                    if s[1] >= 2 * min_weight:  # else no cut of it has two sides
                        nodes.append(child)
            if not nodes:
                break
        for node, (_, _, value, _) in grown.items():
            tree[2][node] = value
        trees.append(tuple((n, f, float(cuts[f][int(c)]) if f >= 0 else 0.0, v, g) for n, (f, c, v, g) in sorted(grown.items())))
        if r + 1 < rounds:
            deepest = max(grown, default=0)
            steps = (deepest + 1).bit_length() - 1
            rows, before = rows.map(lambda b, t=tree, d=steps: _advanced(b, t, d)).persist(HELD), rows
            if (r + 1) % KEEP == 0:
                rows.checkpoint()
    rows.unpersist()
    return BoostedModel(features, depth, tuple(trees))


def boosted_scores(model: BoostedModel, df: DataFrame, out: str = "routine_score") -> DataFrame:
    """``df`` with the probability of an attack in ``out``, scored per Arrow batch."""
    spark = df.sparkSession
    ship_package(spark)
    df = df.drop(out)
    shared, names = spark.sparkContext.broadcast(model), [*df.columns, out]  # at most rounds x 2^(depth + 1) nodes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = shared.value.score(_columns(b, shared.value.features)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
