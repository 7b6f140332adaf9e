"""Random forests without a limit of depth: trees grow until every leaf is pure or cannot be split.

Rows are written once as (label, bins) and take part in each tree with a weight that a hash of tree and row draws from a
Poisson distribution, which is what drawing with replacement comes to. Nodes of more than ``NODE_ROWS`` rows are split
level by level: a pass over the one table walks every row down all trees and sums weights and labels by tree, node, feature
and bin, so no level writes rows. A node that has become small is finished in one task, whatever its depth: its rows
travel there once, and the subtree grows over them to the end. The result is a table of leaves, as ``forest_shap.leaf_table``
gives it, so scores, Shapley values and dependence come from the same operators as for other ensembles; ``cell`` names the node
in which leaves were finished, by which rows find them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.expressions import quoted
from churnlake.operators.forest_shap import CONDITION
from churnlake.operators.models import Preparation, fit_preparation
from churnlake.operators.newton_boosting import bin_sql, feature_cuts
from churnlake.schema import CustomerTable
from churnlake.session import spread, staged

# Functions of this module travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A node of so many rows or fewer is finished in one task.
NODE_ROWS = 100_000
MOST_WEIGHT = 12
#: Open nodes whose histograms one pass adds up.
NODES_HELD = 1_000
#: Rows that a task takes at a time.
BLOCK_ROWS = 100_000
LEAVES = f"tree int, node int, leaf_value double, rows long, path array<{CONDITION}>"


def _weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row takes part in a tree: the Poisson quantile, of mean 1, of a hash."""
    z = row.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + 0xD1B54A32D192ED03 * seed) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST_WEIGHT)]), u, side="right")


def _order(width: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The features in the order in which a node considers them."""
    return np.random.default_rng([seed, tree, node]).permutation(width)


def best_split(weight: np.ndarray, positive: np.ndarray, order: np.ndarray, tried: int) -> tuple[int, int] | None:
    """(feature, bin) of the split with the least Gini impurity among the first ``tried`` features that can be split at all;
    ``weight`` and ``positive``: sums by feature and bin. None if no feature has two bins."""
    best, met = None, 0
    for f in order.tolist():
        n, k = np.cumsum(weight[f]), np.cumsum(positive[f])
        places = np.flatnonzero((weight[f] > 0) & (n < n[-1]))
        if not len(places):
            continue
        left, right = n[places], n[-1] - n[places]
        purity = (k[places] ** 2 + (left - k[places]) ** 2) / left + ((k[-1] - k[places]) ** 2 + (right - k[-1] + k[places]) ** 2) / right
        i = int(np.argmax(purity))
        if best is None or purity[i] > best[0]:
            best = (purity[i], f, int(places[i]))
        met += 1
        if met == tried:
            break
    return None if best is None else best[1:]


def grow(bins: np.ndarray, weight: np.ndarray, label: np.ndarray, n_bins: int, tried: int, seed: int, tree: int, top: int, above: dict) -> Iterator[tuple]:
    """The leaves of a subtree: share of positives, rows, path as {feature: (first bin less one, last bin)}; ``above``: the
    path that leads to it."""
    width = bins.shape[1]
    shift = np.arange(width) * n_bins
    open_nodes, number = [(np.arange(len(label)), above)], 0
    while open_nodes:
        rows, path = open_nodes.pop()
        w, y = weight[rows], label[rows] * weight[rows]
        number += 1
        split = None
        if 0 < y.sum() < w.sum():
            cells = (bins[rows] + shift).ravel()
            sums = [np.bincount(cells, np.repeat(v, width), width * n_bins).reshape(width, n_bins) for v in (w, y)]
            split = best_split(*sums, _order(width, seed, tree, top * 1_000_003 + number), tried)
        if split is None:
            yield float(y.sum() / w.sum()), len(rows), path
            continue
        f, cut = split
        low, high = path.get(f, (-1, n_bins))
        left = bins[rows, f] <= cut
        open_nodes.append((rows[~left], {**path, f: (max(low, cut), high)}))
        open_nodes.append((rows[left], {**path, f: (low, min(high, cut))}))


@dataclass
class _Top:
    """The upper nodes of a tree. ``feature`` and ``cut``: its split, or feature -1; ``below``: its children; ``state``: 0
    waits for a pass, 1 is finished in a task, 2 is split or a leaf; ``sums``: weights, positives and rows, once known."""

    feature: list[int]
    cut: list[int]
    below: list[tuple[int, int]]
    state: list[int]
    paths: list[dict]
    sums: list[tuple[float, float, int] | None]

    def add(self, path: dict, sums: tuple[float, float, int] | None, state: int) -> int:
        for held, value in zip((self.feature, self.cut, self.below, self.state, self.paths, self.sums), (-1, 0, (0, 0), state, path, sums)):
            held.append(value)
        return len(self.feature) - 1

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins lies."""
        feature, cut, below = np.array(self.feature), np.array(self.cut), np.array(self.below)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = below[at, (bins[rows, feature[at]] > cut[at]).astype(np.int64)]
        return node


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, label and bins of some ``BLOCK_ROWS`` rows at a time."""
    held, size = [], 0

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        row, label = (table.column(c).to_numpy() for c in ("row", "label"))
        bins = table.column("bins").combine_chunks()
        return row, label, bins.flatten().to_numpy().reshape(len(row), width)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield taken()
            held, size = [], 0
    if size:
        yield taken()


def _level_splits(
    rows: DataFrame, tops: list[_Top], open_nodes: list[tuple[int, int]], width: int, n_bins: int, tried: int, seed: int, bootstrap: bool
) -> DataFrame:
    """tree, node, feature, cut (null where no feature can be cut) and the sums of the node and of its left child, for
    each of ``open_nodes``: the rows walk down the trees where they lie, and only histograms are shuffled."""
    cells = width * n_bins
    trees = sorted({t for t, _ in open_nodes})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: np.full(len(tops[t].feature), -1) for t in trees}
        for i, (t, node) in enumerate(open_nodes):
            place[t][node] = i
        sums = np.zeros((3, len(open_nodes) * cells))
        shift = np.arange(width) * n_bins
        for row, label, bins in _blocks(batches, width):
            for t in trees:
                slot = place[t][tops[t].reached(bins)]
                weight = _weights(row, t, seed) if bootstrap else np.ones(len(row))
                met = np.flatnonzero((slot >= 0) & (weight > 0))
                if not len(met):
                    continue
                first, last = int(slot[met].min()), int(slot[met].max()) + 1  # the nodes of a tree are neighbours
                code = ((slot[met] - first)[:, None] * cells + shift + bins[met]).ravel()
                for held, values in zip(sums, (weight[met], weight[met] * label[met], np.ones(len(met)))):
                    held[first * cells : last * cells] += np.bincount(code, np.repeat(values, width), (last - first) * cells)
        for i, (t, node) in enumerate(open_nodes):
            part = sums[:, i * cells : (i + 1) * cells]
            cell = np.flatnonzero(part[2])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            columns = (np.full(len(cell), t), np.full(len(cell), node), cell, *part[:, cell])
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["tree", "node", "cell", "w", "k", "n"])

    def solve(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        table = np.zeros((3, cells))
        table[:, group.column("cell").to_numpy()] = [group.column(c).to_numpy() for c in "wkn"]
        table = table.reshape(3, width, n_bins)
        f, cut = best_split(table[0], table[1], _order(width, seed, tree, node + 1), tried) or (None, None)
        whole = table[:, 0].sum(1)
        left = whole if f is None else table[:, f, : cut + 1].sum(1)
        row = {"tree": tree, "node": node, "feature": f, "cut": cut, "whole": whole.tolist(), "left": left.tolist()}
        kinds = pa.schema([(c, pa.int32()) for c in ("tree", "node", "feature", "cut")] + [(c, pa.list_(pa.float64())) for c in ("whole", "left")])
        return pa.Table.from_pylist([row], kinds)

    added = rows.mapInArrow(add, "tree int, node int, cell int, w double, k double, n long")
    summed = added.groupBy("tree", "node", "cell").agg(F.sum("w").alias("w"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return summed.groupBy("tree", "node").applyInArrow(
        solve, "tree int, node int, feature int, cut int, whole array<double>, left array<double>"
    )


def _finished(
    rows: DataFrame, tops: list[_Top], cuts: Sequence[Sequence[float]], n_bins: int, tried: int, seed: int, trees: int, bootstrap: bool
) -> DataFrame:
    """The leaves below the nodes that are small enough to be finished in a task. Only rows of such nodes travel, with
    their bins as bytes."""
    width, kind = len(cuts), np.dtype(np.uint8 if n_bins <= 256 else np.int32)
    small = [(t, np.array(top.state) == 1) for t, top in enumerate(tops) if 1 in top.state]

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "node", "label", "weight", "bins"]
        for row, label, bins in _blocks(batches, width):
            for t, mine in small:
                node = tops[t].reached(bins)
                weight = _weights(row, t, seed) if bootstrap else np.ones(len(row), np.int64)
                met = np.flatnonzero(mine[node] & (weight > 0))
                for start in range(0, len(met), 10_000):
                    part = met[start : start + 10_000]
                    packed = pa.py_buffer(np.ascontiguousarray(bins[part].astype(kind)).tobytes())
                    ends = pa.py_buffer((np.arange(len(part) + 1) * width * kind.itemsize).astype(np.int32).tobytes())
                    ints = (np.full(len(part), t), node[part], label[part], weight[part])
                    columns = [*(pa.array(c).cast(pa.int32()) for c in ints), pa.Array.from_buffers(pa.binary(), len(part), [None, ends, packed])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    def solve(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        flat = np.frombuffer(b"".join(group.column("bins").to_pylist()), kind).astype(np.int64)
        weight, label = (group.column(c).to_numpy().astype(float) for c in ("weight", "label"))
        found = list(grow(flat.reshape(group.num_rows, -1), weight, label, n_bins, tried, seed, tree, node + 1, tops[tree].paths[node]))
        columns = [
            pa.array([tree] * len(found), pa.int32()),
            pa.array([node] * len(found), pa.int32()),
            pa.array([v / trees for v, _, _ in found], pa.float64()),
            pa.array([n for _, n, _ in found], pa.int64()),
            pa.array([_conditions(path, cuts) for _, _, path in found], pa.list_(condition)),
        ]
        return pa.Table.from_arrays(columns, ["tree", "node", "leaf_value", "rows", "path"])

    condition = pa.struct([("feature", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
    handed = rows.mapInArrow(hand_out, "tree int, node int, label int, weight int, bins binary")
    return handed.groupBy("tree", "node").applyInArrow(solve, LEAVES)


def _conditions(path: dict[int, tuple[int, int]], cuts: Sequence[Sequence[float]]) -> list[dict]:
    """low < x <= high for each feature of a path of bins; an open end is None."""

    def value(f: int, i: int) -> float | None:
        return cuts[f][i] if 0 <= i < len(cuts[f]) else None

    return [{"feature": f, "low": value(f, a), "high": value(f, b)} for f, (a, b) in sorted(path.items())]


@dataclass(frozen=True)
class DeepForest:
    """``leaves``: tree, leaf, leaf_value (its share of class 1 over the number of trees), path, rows, cell; the values at
    which features may be cut."""

    preparation: Preparation
    leaves: DataFrame
    cuts: Sequence[Sequence[float]]

    def bins_sql(self, values: Sequence[str]) -> str:
        return _bins_sql(values, self.cuts)


def _bins_sql(values: Sequence[str], cuts: Sequence[Sequence[float]]) -> str:
    """The bins of the features; a missing value lies above every cut."""
    return f"array({', '.join(f'IF({v} IS NULL OR isnan({v}), {len(c)}, {bin_sql(v, c)})' for v, c in zip(values, cuts))})"


def fit_deep_forest(
    train: DataFrame,
    spec: CustomerTable,
    trees: int = 100,
    tried: int | None = None,
    max_bins: int = 256,
    seed: int = 42,
    preparation: Preparation | None = None,
    bootstrap: bool = True,
    node_rows: int | None = None,
) -> DeepForest:
    """A forest of any depth.

    A node considers features in an order drawn for it until ``tried`` of them (default: the root of their number) can be
    split, and is split as long as it holds both classes and any feature differs; features are told apart by at most
    ``max_bins`` bins. ``bootstrap=False`` gives every row the weight 1. Rows without label are left out; without rows
    there are no leaves. The driver sees one row for each node of more than ``node_rows`` rows.
    """
    spark, node_rows = train.sparkSession, node_rows or NODE_ROWS
    preparation = preparation or fit_preparation(train, spec, scaled=False)
    label = F.col(quoted(spec.label))
    names = [f"x_{i}" for i in range(len(preparation.features))]
    width = len(names)
    tried = tried or max(1, math.isqrt(width))
    inputs = train.where(label.isNotNull()).select(
        F.xxhash64(F.col(quoted(spec.id))).alias("row"),
        label.cast("int").alias("label"),
        *[F.expr(e).alias(n) for e, n in zip(preparation.expressions, names)],
    )
    cuts = feature_cuts(inputs, names, max_bins)
    rows = staged(spread(inputs.selectExpr("row", "label", f"{_bins_sql(names, cuts)} AS bins")), "binned")
    tops = [_Top([], [], [], [], [], []) for _ in range(trees)]
    n_rows = rows.count()
    for top in tops:  # with a bootstrap a tree draws about as many rows as there are, and its first pass tells how many
        top.add({}, None, 0 if n_rows > node_rows else 1)

    def child(top: _Top, path: dict, sums: tuple[float, float, int]) -> int:
        mixed = 0 < sums[1] < sums[0]
        return top.add(path, sums, 2 if not mixed else 1 if sums[2] <= node_rows else 0)

    while n_rows:
        waiting = [(t, node) for t, top in enumerate(tops) for node, state in enumerate(top.state) if state == 0]
        if not waiting:
            break
        for start in range(0, len(waiting), NODES_HELD):
            found = _level_splits(rows, tops, waiting[start : start + NODES_HELD], width, max_bins, tried, seed, bootstrap)
            for r in sorted(found.collect(), key=lambda r: (r["tree"], r["node"])):  # a row for each open node
                top, node = tops[r["tree"]], r["node"]
                top.state[node], top.sums[node] = 2, tuple(r["whole"])
                w, k, n = r["whole"]
                if r["feature"] is None or not 0 < k < w:  # no feature tells its rows apart, or all are of one class
                    continue
                f, cut, path = r["feature"], r["cut"], top.paths[node]
                low, high = path.get(f, (-1, max_bins))
                left = child(top, {**path, f: (low, min(high, cut))}, tuple(r["left"]))
                right = child(top, {**path, f: (max(low, cut), high)}, tuple(a - b for a, b in zip(r["whole"], r["left"])))
                top.feature[node], top.cut[node], top.below[node] = f, cut, (left, right)
    ended = [
        (t, node, top.sums[node][1] / top.sums[node][0] / trees, int(top.sums[node][2]), _conditions(top.paths[node], cuts))
        for t, top in enumerate(tops)
        for node, state in enumerate(top.state)
        if state == 2 and top.feature[node] < 0 and top.sums[node][0]
    ]
    leaves = _finished(rows, tops, cuts, max_bins, tried, seed, trees, bootstrap).unionAll(spark.createDataFrame(ended, LEAVES))
    leaves = leaves.withColumn("leaf", F.monotonically_increasing_id())
    return DeepForest(preparation, staged(leaves.selectExpr("tree", "leaf", "leaf_value", "path", "rows", "node AS cell"), "deep-forest"), cuts)
