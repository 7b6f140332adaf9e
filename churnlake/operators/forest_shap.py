"""Interventional Shapley values and partial dependence of tree ensembles, from counts of path masks.

Every leaf is a box: a list of conditions, one for each feature on its path. For a row and a leaf, a bit mask tells
which of these conditions hold, bit i being the i-th condition of the leaf's own path, so a mask is as wide as
a path and not as the table. The contribution of a leaf depends on the row only through its mask, and on the
background only through how often each mask occurs, so

1. the background is reduced to (leaf, mask, count), a row for each leaf and block;
2. where the explained rows of a block meet a leaf, each of their masks gets its contributions once, from these counts;
3. rows look them up by mask and sum them, reduced to one row for each id and part of the model.

Rows meet leaves in blocks: a part of the model (at most some ``LEAF_LIMIT`` leaves) and a block of rows lie in one task,
where rows first collapse to distinct tuples of outcomes of the cuts of some neighbouring leaves. The product of rows and
leaves is never a table. Leaves are a table as well, made by joins over the saved nodes; nothing of the model and nothing of the
rows passes through the driver or a broadcast.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.expressions import doubles, quoted, to_rows
from churnlake.operators.models import Fitted
from churnlake.session import new_path, staged

# Functions of this module travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leaves of a part of the model, and rows of a block. With more leaves than ``LEAST_LEAVES`` for each core the parts are
#: smaller.
LEAF_LIMIT, BLOCK_ROWS, LEAST_LEAVES = 20_000, 500_000, 500
#: So many tuples of outcomes are always told apart at once.
LEAST_ROOM = 1 << 12
#: Paths of up to so many conditions are counted in arrays with a place for every mask.
DENSE_PATH = 16
#: Pairs of masks that are compared at once.
PAIRS = 1 << 20
CONDITION = "struct<feature: int, low: double, high: double>"
LEAF_SCHEMA = f"tree int, leaf long, leaf_value double, path array<{CONDITION}>"


@dataclass(frozen=True)
class Leaf:
    """A leaf's value (tree weight included) and its box: low < x <= high per feature index."""

    tree: int
    value: float
    low: Mapping[int, float] = field(default_factory=dict)
    high: Mapping[int, float] = field(default_factory=dict)


Leaves = DataFrame | Sequence[Leaf]


def leaf_table(spark: SparkSession, learner) -> DataFrame:
    """tree, leaf, leaf_value, path of a fitted Spark tree, forest or boosted ensemble; path: a condition low < x <= high
    for each feature on the way, by feature; an open end is null.

    Forest leaves hold the class-1 share divided by the number of trees, so their sum is the probability; boosted
    leaves hold weighted predictions, so their sum is the margin. Paths grow by pointer doubling: in each round a node
    takes over the conditions of the node that it points to, and points where that one does.
    """
    path = new_path(spark, "learner")
    learner.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in nodes.columns
    node = F.struct("*") if single else F.col("nodeData")
    flat = nodes.select((F.lit(0) if single else F.col("treeID")).alias("tree"), node.alias("n")).select(
        "tree",
        F.col("n.id").alias("node"),
        "n.prediction",
        "n.impurityStats",
        "n.leftChild",
        "n.rightChild",
        F.col("n.split.featureIndex").alias("feature"),
        F.try_element_at("n.split.leftCategoriesOrThreshold", F.lit(1)).alias("cut"),
        F.col("n.split.numCategories").alias("categories"),
    )
    inner = flat.where("leftChild >= 0")
    if not inner.where("categories <> -1").isEmpty():
        raise ValueError("categorical splits are not supported; one-hot encode the features")
    left = f"struct(leftChild AS node, CAST(struct(feature, CAST(NULL AS double), cut) AS {CONDITION}) AS c)"
    right = f"struct(rightChild AS node, CAST(struct(feature, cut, CAST(NULL AS double)) AS {CONDITION}) AS c)"
    paths = staged(inner.selectExpr("tree", "node AS up", f"inline(array({left}, {right}))").selectExpr("tree", "node", "up", "array(c) AS way"), "paths")
    while not paths.where("up <> 0").isEmpty():
        further = paths.selectExpr("tree", "node AS up", "up AS top", "way AS more")
        paths = paths.join(further, ["tree", "up"], "left").selectExpr(
            "tree", "node", "coalesce(top, up) AS up", "CASE WHEN more IS NULL THEN way ELSE concat(way, more) END AS way"
        )
        paths = staged(paths, "paths")
    if type(learner).__name__.startswith("GBT"):
        value = F.col("prediction") * doubles(learner.treeWeights)[F.col("tree")]
    else:
        count = 1 if single else learner.getNumTrees
        value = F.col("impurityStats")[1] / F.expr("aggregate(impurityStats, 0D, (s, x) -> s + x)") / count
    leaves = flat.where("leftChild < 0").select("tree", F.col("node").cast("long").alias("leaf"), value.alias("leaf_value"))
    steps = paths.selectExpr("tree", "CAST(node AS long) AS leaf", "inline(way)")
    boxes = steps.groupBy("tree", "leaf", "feature").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    boxes = boxes.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("feature", "low", "high"))).alias("path"))
    whole = leaves.join(boxes, ["tree", "leaf"], "left")
    whole = whole.select("tree", "leaf", "leaf_value", F.coalesce("path", F.expr(f"CAST(array() AS array<{CONDITION}>)")).alias("path"))
    return staged(whole, "leaves")


def model_leaves(spark: SparkSession, learner) -> list[Leaf]:
    """The rows of ``leaf_table`` as objects, to look at a model by hand."""
    return [
        Leaf(
            r["tree"],
            r["leaf_value"],
            {c["feature"]: c["low"] for c in r["path"] if c["low"] is not None},
            {c["feature"]: c["high"] for c in r["path"] if c["high"] is not None},
        )
        for r in leaf_table(spark, learner).orderBy("tree", "leaf").collect()
    ]


def _table(spark: SparkSession, leaves: Leaves) -> DataFrame:
    if isinstance(leaves, DataFrame):
        return leaves
    rows = [
        (x.tree, i, float(x.value), [(f, x.low.get(f), x.high.get(f)) for f in sorted({*x.low, *x.high})])
        for i, x in enumerate(leaves)
    ]
    return spark.createDataFrame(rows, LEAF_SCHEMA)


def feature_rows(fitted: Fitted, df: DataFrame, id_col: str) -> DataFrame:
    """The id and the model inputs of each row, by feature name."""
    preparation = fitted.preparation
    return df.select(
        id_col, *[F.expr(e).cast("double").alias(n) for n, e in zip(preparation.features, preparation.expressions)]
    )


def _inputs(rows: DataFrame, features: Sequence[str]) -> Column:
    """The features as one array; a missing value is NaN, which lies above every cut, as learners have it."""
    return F.array(*[F.coalesce(F.col(quoted(c)).cast("double"), F.lit(float("nan"))) for c in features])


@dataclass(frozen=True)
class _Boxes:
    """The leaves of a task, by tree and number: their places in the table, and their conditions as ranks among all cuts
    of a feature: ``low`` < rank <= ``high``, where a value's rank is the number of cuts below it."""

    trees: np.ndarray
    places: np.ndarray
    cuts: Mapping[int, np.ndarray]
    starts: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, leaves: pa.Table) -> _Boxes:
        path = leaves.column("path").combine_chunks()
        sizes = path.value_lengths().to_numpy()
        tree, number = (leaves.column(c).to_numpy() for c in ("tree", "leaf"))
        places = np.lexsort((number, tree))
        conditions = path.flatten()
        starts = np.cumsum(sizes) - sizes
        order = np.repeat(starts[places] - np.cumsum(sizes[places]) + sizes[places], sizes[places]) + np.arange(sizes.sum())
        feature = conditions.field("feature").to_numpy()[order]
        low, high = (conditions.field(n).to_numpy(zero_copy_only=False).astype(float)[order] for n in ("low", "high"))
        low_rank, high_rank, cuts = np.full(len(order), -1), np.full(len(order), np.iinfo(np.int32).max), {}
        for f in np.unique(feature).tolist():
            own = np.flatnonzero(feature == f)
            both = np.concatenate((low[own], high[own]))
            cuts[f] = np.unique(both[~np.isnan(both)])
            for rank, values in ((low_rank, low), (high_rank, high)):
                given = own[~np.isnan(values[own])]
                rank[given] = np.searchsorted(cuts[f], values[given])
        return cls(tree[places], places, cuts, np.concatenate(([0], np.cumsum(sizes[places]))), feature, low_rank, high_rank)

    def ranks(self, x: np.ndarray) -> dict[int, np.ndarray]:
        return {f: np.searchsorted(values, x[:, f]).astype(np.int32) for f, values in self.cuts.items()}

    def path(self, i: int) -> slice:
        return slice(int(self.starts[i]), int(self.starts[i + 1]))


def _packs(boxes: _Boxes, room: int) -> Iterator[tuple[range, dict[int, list[int]]]]:
    """Neighbouring leaves of a tree, with the cuts that tell their rows apart: as many leaves as have at most ``room``
    tuples of outcomes of these cuts."""
    start, known = 0, {}
    for i in range(len(boxes.trees)):
        own, part = boxes.path(i), {f: set(c) for f, c in known.items()} if i > start else {}
        for f, a, b in zip(boxes.feature[own].tolist(), boxes.low[own].tolist(), boxes.high[own].tolist()):
            part.setdefault(f, set()).update(c for c in (a, b) if 0 <= c < len(boxes.cuts[f]))
        if i > start and (boxes.trees[i] != boxes.trees[start] or math.prod(len(c) + 1 for c in part.values()) > room):
            yield range(start, i), {f: sorted(c) for f, c in known.items()}
            start = i
            part = {f: {c for j in np.flatnonzero(boxes.feature[own] == f) for c in (int(boxes.low[own][j]), int(boxes.high[own][j]))
                        if 0 <= c < len(boxes.cuts[f])} for f in boxes.feature[own].tolist()}
        known = part
    if len(boxes.trees):
        yield range(start, len(boxes.trees)), {f: sorted(c) for f, c in known.items()}


def _pack_masks(
    x: np.ndarray, leaves: pa.Table
) -> Iterator[tuple[np.ndarray, int, Iterator[tuple[int, list[int], np.ndarray]]]]:
    """For each pack of leaves: the signature of each row, their number, and for each leaf its place in ``leaves``, the
    features of its path and the mask of every signature. Rows with the same outcomes of a pack's cuts share a signature, so
    the work by leaf is that of signatures, and that of rows is done once a pack."""
    boxes = _Boxes.of(leaves)
    ranks, room = boxes.ranks(x), max(LEAST_ROOM, len(x) // 8)
    for members, cuts in _packs(boxes, room):
        code, size = np.zeros(len(x), np.int64), 1
        below = {f: np.searchsorted(c, np.arange(len(boxes.cuts[f]) + 1)) for f, c in cuts.items()}
        met, levels = np.zeros(1, np.int64), {}
        for f, c in cuts.items():
            if size * (len(c) + 1) > max(room, 1 << 20):  # a path of many cuts: keep to the tuples that occur
                met, code = np.unique(code, return_inverse=True)
                levels, size = {g: v[met] if len(v) else v for g, v in levels.items()}, len(met)
            code = code + (below[f] * size)[ranks[f]]
            levels = {g: np.tile(v, len(c) + 1) for g, v in levels.items()}
            levels[f] = np.repeat(np.arange(len(c) + 1), size)
            size *= len(c) + 1
        counts = np.bincount(code, minlength=size)
        met = np.flatnonzero(counts)
        back = (np.cumsum(counts > 0) - 1)[code]
        levels = {f: v[met] for f, v in levels.items()}

        def masks(members=members, cuts=cuts, levels=levels, count=len(met)):
            for i in members:
                own, mask = boxes.path(i), np.zeros(count, np.int64)
                names = boxes.feature[own].tolist()
                for place, (f, a, b) in enumerate(zip(names, boxes.low[own].tolist(), boxes.high[own].tolist())):
                    level = np.arange(len(cuts[f]) + 1)  # a level is the number of the pack's cuts below the value
                    holds = (level > (cuts[f].index(a) if a >= 0 else -1)) & (level <= (cuts[f].index(b) if b < len(boxes.cuts[f]) else len(cuts[f])))
                    mask |= (holds.astype(np.int64) << place)[levels[f]]
                yield int(boxes.places[i]), names, mask

        yield back, len(met), masks()


def _located(x: np.ndarray, boxes: _Boxes, members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the ``members`` and the rows that lie in it. Rows and boxes are divided at cuts that no box straddles, as
    the trees that they come from have; boxes that no cut divides are compared with all rows left."""
    width = max(boxes.cuts, default=-1) + 1
    most = max((len(c) for c in boxes.cuts.values()), default=0)
    rank = np.zeros((len(x), width), np.int32)
    for f, values in boxes.ranks(x).items():
        rank[:, f] = values
    low, high = np.full((len(members), width), -1, np.int32), np.full((len(members), width), most, np.int32)
    owner = np.repeat(np.arange(len(members)), [boxes.starts[i + 1] - boxes.starts[i] for i in members])
    own = np.concatenate([np.arange(boxes.starts[i], boxes.starts[i + 1]) for i in members]) if len(members) else owner
    low[owner, boxes.feature[own]] = boxes.low[own]
    high[owner, boxes.feature[own]] = np.minimum(boxes.high[own], most)
    shift = np.arange(width) * (most + 2)
    waiting = [(np.arange(len(x)), np.arange(len(members)))]
    while waiting:
        rows, inside = waiting.pop()
        if not len(rows) or not len(inside):
            continue
        best = None
        if len(inside) > 4:
            ends = np.bincount((high[inside] + shift).ravel(), minlength=width * (most + 2)).reshape(width, -1).cumsum(1)
            begins = np.bincount((low[inside] + 1 + shift).ravel(), minlength=width * (most + 2)).reshape(width, -1).cumsum(1)
            # a cut has ends[cut] boxes up to it, and len - begins[cut] beyond it: begins counts low + 1
            clean = ends + len(inside) - begins == len(inside)
            clean &= (ends > 0) & (ends < len(inside))
            if clean.any():
                best = divmod(int(np.argmin(np.where(clean, np.abs(2 * ends - len(inside)), 2 * len(inside) + 1))), most + 2)
        if best is not None:
            f, cut = best
            left, first = rank[rows, f] <= cut, high[inside, f] <= cut
            waiting += [(rows[left], inside[first]), (rows[~left], inside[~first])]
            continue
        here = rank[rows]
        for i in inside.tolist():
            in_box = rows[((here > low[i]) & (here <= high[i])).all(1)]
            if len(in_box):
                yield int(members[i]), in_box


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("x").combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1)


def _meet(
    rows: DataFrame, n_rows: int, leaves: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    leaf_limit: int, block_rows: int,
) -> DataFrame:
    """``solve`` of every block of rows with every part of the leaves. A part holds whole trees, or equal shares of a tree
    of more than ``leaf_limit`` leaves."""
    n_leaves, n_trees = leaves.agg(F.count("*"), F.countDistinct("tree")).first()
    shares = max(1, -(-n_leaves // max(1, n_trees * leaf_limit)))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-max(1, n_leaves) // leaf_limit), min(tasks, max(1, n_leaves // LEAST_LEAVES)))
    parts, blocks = min(parts, max(1, n_trees) * shares), max(1, -(-n_rows // block_rows))
    part = F.expr(f"CAST(pmod(tree * {shares} + leaf % {shares}, {parts}) AS int)")
    left = rows.withColumn("block", F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), F.lit(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = leaves.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left, right = (side.repartition(parts * blocks, "part", "block").groupBy("part", "block") for side in (left, right))
    return left.cogroup(right).applyInArrow(solve, schema)


def _seen(
    rows: DataFrame, leaves: DataFrame, features: Sequence[str], leaf_limit: int, block_rows: int, lacking: int | None = None
) -> DataFrame:
    """tree, leaf, hits, ns: the masks that occur in a block of rows and how many rows have them; a leaf has a row for each
    block. ``lacking``: only masks that lack so many conditions at most. Equal rows collapse first."""
    inputs = staged(rows.select(_inputs(rows, features).alias("x")).groupBy("x").agg(F.count("*").alias("n")), "inputs")

    def solve(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        trees, numbers = leaves.column("tree").to_pylist(), leaves.column("leaf").to_pylist()
        out = ([], [], [], [])
        if rows.num_rows and leaves.num_rows:
            weight = rows.column("n").to_numpy()
            for back, count, masks in _pack_masks(_matrix(rows), leaves):
                totals = np.bincount(back, weight, count)
                for leaf, path, mask in masks:
                    if len(path) <= DENSE_PATH:
                        sums = np.bincount(mask, totals, 1 << len(path))
                        hit = np.flatnonzero(sums)
                        sums = sums[hit]
                    else:
                        hit, place = np.unique(mask, return_inverse=True)
                        sums = np.bincount(place.ravel(), totals)
                    if lacking is not None:
                        near = len(path) - _bits(hit, len(path)).sum(1) <= lacking
                        hit, sums = hit[near], sums[near]
                    if len(hit):
                        for held, values in zip(out, (trees[leaf], numbers[leaf], hit, sums)):
                            held.append(values)
        ends = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in out[2]]))), pa.int32(), safe=False)
        hits, ns = (pa.array(np.concatenate(c) if c else [], pa.int64(), safe=False) for c in out[2:])
        columns = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.ListArray.from_arrays(ends, c) for c in (hits, ns))]
        return pa.Table.from_arrays(columns, ["tree", "leaf", "hits", "ns"])

    return _meet(inputs, inputs.count(), leaves, solve, "tree int, leaf long, hits array<long>, ns array<long>", leaf_limit, block_rows)


def mask_counts(
    rows: DataFrame,
    leaves: Leaves,
    features: Sequence[str],
    leaf_limit: int = LEAF_LIMIT,
    block_rows: int = BLOCK_ROWS,
    lacking: int | None = None,
) -> DataFrame:
    """tree, leaf, hit, n: how many rows satisfy just the conditions in the mask ``hit``; with ``lacking`` only for masks
    that lack so many conditions at most."""
    met = _seen(rows, _table(rows.sparkSession, leaves), features, leaf_limit, block_rows, lacking)
    each = met.selectExpr("tree", "leaf", "inline(arrays_zip(hits, ns)) AS (hit, n)")
    return each.groupBy("tree", "leaf", "hit").agg(F.sum("n").alias("n"))


def _bits(masks: np.ndarray, size: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(size)) & 1


def _weights(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shapley weights, by b and a, for a features where only the row is inside and b where only the background is: for
    each of the former a gain of (a-1)! b! / (a+b)!, for each of the latter a loss of a! (b-1)! / (a+b)!."""
    f = math.factorial
    gain = [[f(a - 1) * f(b) / f(a + b) if a else 0.0 for a in range(size + 1)] for b in range(size + 1)]
    loss = [[-f(a) * f(b - 1) / f(a + b) if b else 0.0 for a in range(size + 1)] for b in range(size + 1)]
    return np.array(gain), np.array(loss)


def _contributions(hits: np.ndarray, seen: np.ndarray, n: np.ndarray, size: int, gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """What each condition of a path gets for each mask of a row, from the background's masks ``seen`` and their counts.

    Only masks that complete each other count. Then the background alone is inside where the row's mask has no bit, and the
    row alone where the background's has none, so their numbers are known from one side each."""
    out = np.zeros((len(hits), size))
    theirs = _bits(seen, size)
    a = size - theirs.sum(1)
    with_gain, with_loss = (1 - theirs) * n[:, None], theirs * n[:, None]
    step = max(1, PAIRS // max(1, len(seen)))
    for start in range(0, len(hits), step):
        part = hits[start : start + step]
        ours = _bits(part, size)
        place = np.ix_(size - ours.sum(1), a)
        complete = (part[:, None] | seen) == (1 << size) - 1
        out[start : start + step] = ours * ((complete * gain[place]) @ with_gain) + (1 - ours) * ((complete * loss[place]) @ with_loss)
    return out


def forest_shap(
    rows: DataFrame,
    background: DataFrame,
    leaves: Leaves,
    id_col: str,
    features: Sequence[str],
    leaf_limit: int = LEAF_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Shapley values (id, feature, feature_value, shap_value) of every row against the background. Paths may
    have up to 62 features; tables may have any number."""
    leaves = _table(rows.sparkSession, leaves)
    n_background = background.count()
    if n_background == 0:
        raise ValueError("the background is empty")
    size = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    if size > 62:
        raise ValueError("at most 62 features on a path")
    seen = _seen(background, leaves, features, leaf_limit, block_rows).groupBy("tree", "leaf").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("ns")).alias("ns")
    )
    known = staged(leaves.select("tree", "leaf", "leaf_value", "path").join(seen, ["tree", "leaf"]), "background")
    explained = rows.select(F.col(quoted(id_col)).alias("id"), _inputs(rows, features).alias("x"))
    width = len(features)
    names = [f"phi_{i}" for i in range(width)]
    weights = [_weights(d) for d in range(size + 1)]

    def solve(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        total = np.zeros((width, rows.num_rows))
        if rows.num_rows and leaves.num_rows:
            hits, ns, values = (leaves.column(c).combine_chunks() for c in ("hits", "ns", "leaf_value"))
            for back, count, masks in _pack_masks(_matrix(rows), leaves):
                sums: dict[int, np.ndarray] = {}
                for leaf, path, mask in masks:
                    if path:
                        own, place = np.unique(mask, return_inverse=True)
                        counts = ns[leaf].values.to_numpy() * (values[leaf].as_py() / n_background)
                        phis = _contributions(own, hits[leaf].values.to_numpy(), counts, len(path), *weights[len(path)])
                        for i, f in enumerate(path):
                            sums[f] = sums.get(f, 0.0) + phis[place.ravel(), i]
                for f, values_of in sums.items():
                    total[f] += values_of[back]
        return pa.Table.from_arrays([rows.column("id"), *map(pa.array, total)], ["id", *names])

    kind = explained.schema["id"].dataType.simpleString()
    parts = _meet(explained, rows.count(), known, solve, f"id {kind}, " + ", ".join(f"{n} double" for n in names), leaf_limit, block_rows)
    whole = parts.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).withColumnRenamed("id", id_col)
    return to_rows(
        rows.select(id_col, *[quoted(c) for c in features]).join(whole, id_col, "left"),
        [
            {
                "feature": F.lit(c),
                "feature_value": F.col(quoted(c)),
                "shap_value": F.coalesce(F.col(names[i]), F.lit(0.0)),
            }
            for i, c in enumerate(features)
        ],
        [id_col],
    )


def _cells(leaves: DataFrame) -> pa.Table:
    """tree, leaf (its cell) and path of the least box around the leaves of each cell: a condition holds for a cell if all
    of its leaves have an end there. One row for each cell reaches the driver."""
    sizes = leaves.groupBy("tree", "cell").agg(F.count("*").alias("k"))
    ends = leaves.selectExpr("tree", "cell", "inline(path)").groupBy("tree", "cell", "feature").agg(
        *[F.count(c).alias(f"n_{c}") for c in ("low", "high")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    ends = ends.join(sizes, ["tree", "cell"]).where("n_low = k OR n_high = k")
    box = F.expr(f"CAST(struct(feature, IF(n_low = k, low, NULL), IF(n_high = k, high, NULL)) AS {CONDITION})")
    boxes = ends.groupBy("tree", "cell").agg(F.array_sort(F.collect_list(box)).alias("path"))
    path = F.coalesce("path", F.expr(f"CAST(array() AS array<{CONDITION}>)")).alias("path")
    return sizes.join(boxes, ["tree", "cell"], "left").select("tree", F.col("cell").cast("long").alias("leaf"), path).toArrow()


def forest_output(
    rows: DataFrame, leaves: Leaves, id_col: str, features: Sequence[str], leaf_limit: int = LEAF_LIMIT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ensemble output of every row, from the leaf boxes.

    Where the leaves have a column ``cell`` that tells which leaves of a tree lie together, and are many, a row only
    travels to the cells in which it lies, one for each tree, instead of meeting every part of the model."""
    leaves = _table(rows.sparkSession, leaves)
    inputs = rows.select(F.col(quoted(id_col)).alias("id"), _inputs(rows, features).alias("x"))

    def solve(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        total = np.zeros(rows.num_rows)
        if rows.num_rows and leaves.num_rows:
            x, boxes = _matrix(rows), _Boxes.of(leaves)
            values = leaves.column("leaf_value").to_numpy()
            for tree in np.unique(boxes.trees):
                for i, inside in _located(x, boxes, np.flatnonzero(boxes.trees == tree)):
                    total[inside] += values[boxes.places[i]]
        return pa.Table.from_arrays([rows.column("id"), pa.array(total)], ["id", "output"])

    kind = inputs.schema["id"].dataType.simpleString()
    schema, n_rows = f"id {kind}, output double", rows.count()
    celled = "cell" in leaves.columns and leaves.count() > leaf_limit
    if celled:
        parts = _meet_cells(inputs, n_rows, leaves, solve, kind, schema, block_rows)
    else:
        parts = _meet(inputs, n_rows, leaves.select("tree", "leaf", "leaf_value", "path"), solve, schema, leaf_limit, block_rows)
    return parts.groupBy(F.col("id").alias(id_col)).agg(F.sum("output").alias("output"))


def _meet_cells(
    rows: DataFrame, n_rows: int, leaves: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], kind: str, schema: str, block_rows: int
) -> DataFrame:
    """``solve`` of the rows of each cell with its leaves."""
    cells = _cells(leaves)
    n_trees = len(set(cells.column("tree").to_pylist()))
    blocks = max(1, -(-n_rows * n_trees // (block_rows * max(1, cells.num_rows))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes, numbers = _Boxes.of(cells), cells.column("leaf").to_numpy()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for tree in np.unique(boxes.trees):
                found = list(_located(_matrix(table), boxes, np.flatnonzero(boxes.trees == tree)))
                if found:
                    taken = batch.take(pa.array(np.concatenate([r for _, r in found])))
                    cell = np.repeat([numbers[boxes.places[i]] for i, _ in found], [len(r) for _, r in found])
                    columns = [*taken.columns, pa.array(np.full(len(cell), tree), pa.int32()), pa.array(cell, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "x", "tree", "cell"])

    routed = rows.mapInArrow(route, f"id {kind}, x array<double>, tree int, cell long")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    right = leaves.select("tree", F.col("cell").cast("long").alias("cell"), "leaf", "leaf_value", "path")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    slices = max(1, min(cells.num_rows * blocks, 8 * rows.sparkSession.sparkContext.defaultParallelism))
    keys = ("tree", "cell", "block")
    left, right = (side.repartition(slices, *keys).groupBy(*keys) for side in (routed, right))
    return left.cogroup(right).applyInArrow(solve, schema)


def forest_base_value(background: DataFrame, leaves: Leaves, features: Sequence[str], leaf_limit: int = LEAF_LIMIT) -> float:
    """The mean ensemble output over the background: the base value of ``forest_shap``."""
    leaves = _table(background.sparkSession, leaves)
    counts = mask_counts(background, leaves, features, leaf_limit, lacking=0).join(leaves, ["tree", "leaf"])
    inside = counts.where("hit = shiftleft(1L, size(path)) - 1")
    return (inside.agg(F.expr("sum(leaf_value * n)")).first()[0] or 0.0) / background.count()


def forest_partial_dependence(
    rows: DataFrame,
    leaves: Leaves,
    features: Sequence[str],
    grids: Mapping[str, Sequence[float]],
    leaf_limit: int = LEAF_LIMIT,
) -> DataFrame:
    """Exact partial dependence without copying rows per grid point.

    Per leaf and examined feature it is enough to know how many rows satisfy all other path
    conditions; grid points then meet these model-sized counts.
    """
    leaves = _table(rows.sparkSession, leaves)
    counts = mask_counts(rows, leaves, features, leaf_limit, lacking=1).join(leaves, ["tree", "leaf"])
    index = {f: i for i, f in enumerate(features)}
    asked = [
        {"feature": F.lit(f), "place": F.expr(f"array_position(path.feature, {index[f]}) - 1"), "grid": doubles(values)}
        for f, values in grids.items()
    ]
    met = to_rows(counts, asked, ["tree", "leaf", "leaf_value", "path", "hit", "n"])
    all_others = met.where("hit | CASE WHEN place >= 0 THEN shiftleft(1L, int(place)) ELSE 0L END = shiftleft(1L, size(path)) - 1")
    weights = all_others.withColumn("c", F.expr("CASE WHEN place >= 0 THEN get(path, int(place)) END"))
    weights = weights.groupBy("feature", "grid", "c.low", "c.high").agg(F.expr("sum(leaf_value * n)").alias("w"))
    points = weights.withColumn("value", F.explode("grid"))
    inside = F.expr("(low IS NULL OR value > low) AND (high IS NULL OR value <= high)")
    total = rows.count()
    return points.groupBy("feature", "value").agg((F.sum(F.when(inside, F.col("w")).otherwise(0.0)) / F.lit(total)).alias("average_score"))
