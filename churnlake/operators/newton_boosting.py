"""Second-order gradient boosting on histograms that Spark sums.

Every feature is cut into at most ``max_bins`` bins by one pass of sketches; the training rows are written once as (label,
bins, margin). A level of a tree is one job: gradients and Hessians of the log-loss are summed by node, feature and
bin, already reduced in each task, and the best cut of every node is found among these sums by windows over bins. Missing
values have a bin of their own that goes with either side, whichever gains more. After each tree the margins are
written anew, so no pass has to walk earlier trees. The driver sees one row for each node.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import double_sql, quoted
from churnlake.operators.models import Preparation, fit_preparation
from churnlake.schema import CustomerTable
from churnlake.session import staged


@dataclass(frozen=True)
class Split:
    """A cut of a node: values up to ``cut`` go left, missing ones where ``missing_left`` says."""

    feature: int
    bin: int
    cut: float
    missing_left: bool
    gain: float


@dataclass(frozen=True)
class Tree:
    """Splits and leaf weights by node number: 1 is the root, 2 n and 2 n + 1 are the children of n. ``sums``: gradient and
    Hessian sums of the leaves."""

    splits: Mapping[int, Split]
    weights: Mapping[int, float]
    sums: Mapping[int, tuple[float, float]]

    def _walk(self, node: int, depth: int, test, end) -> str:
        if node not in self.splits or depth == 0:
            return end(node)
        left, right = (self._walk(child, depth - 1, test, end) for child in (2 * node, 2 * node + 1))
        return f"IF({test(self.splits[node])}, {left}, {right})"

    def node_sql(self, depth: int = 64) -> str:
        """The node that a row of bins has reached after ``depth`` levels."""
        return self._walk(1, depth, _bin_test, str)

    def weight_sql(self, values: Sequence[str] | None = None) -> str:
        """The leaf weight of a row of bins, or of the features' ``values`` (SQL)."""
        test = _bin_test if values is None else lambda s: _value_test(s, values[s.feature])
        return self._walk(1, 64, test, lambda node: double_sql(self.weights[node]))


def _bin_test(split: Split) -> str:
    bin_ = f"bins[{split.feature}]"
    return f"{bin_} <= {split.bin}" if split.missing_left else f"{bin_} BETWEEN 0 AND {split.bin}"


def _value_test(split: Split, value: str) -> str:
    return f"COALESCE(nullif({value}, double('NaN')) <= {double_sql(split.cut)}, {str(split.missing_left).lower()})"


@dataclass(frozen=True)
class NewtonBoosting:
    """A fitted ensemble; ``losses``: the mean log-loss of the training rows before the first tree and after each."""

    preparation: Preparation
    base: float
    trees: Sequence[Tree]
    losses: Sequence[float] = field(default=())

    def margin_sql(self, rounds: int | None = None) -> str:
        names = [f"x_{i}" for i in range(len(self.preparation.features))]
        return " + ".join([double_sql(self.base), *[t.weight_sql(names) for t in self.trees[:rounds]]])

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score, the class-1 probability, and prediction."""
        inputs = [f"{e} AS x_{i}" for i, e in enumerate(self.preparation.expressions)]
        made = [f"x_{i}" for i in range(len(inputs))]
        with_margin = df.selectExpr("*", *inputs).selectExpr("*", f"{self.margin_sql()} AS _margin").drop(*made)
        scored = with_margin.withColumn("score", F.expr("1D / (1D + exp(-_margin))")).drop("_margin")
        return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def feature_cuts(rows: DataFrame, names: Sequence[str], max_bins: int) -> list[list[float]]:
    """Ascending values at which each feature may be cut, never its greatest value: a split sends rows both ways."""
    shares = ", ".join(f"{i / max_bins!r}D" for i in range(1, max_bins))
    found = rows.selectExpr(
        *[f"percentile_approx({n}, array({shares}), {100 * max_bins}) AS p{i}" for i, n in enumerate(names)],
        *[f"max({n}) AS m{i}" for i, n in enumerate(names)],
    ).first()
    return [sorted(v for v in set(found[f"p{i}"] or []) if v < found[f"m{i}"]) for i in range(len(names))]


def bin_sql(value: str, cuts: Sequence[float]) -> str:
    """How many cuts lie below the value, as a tree of comparisons; -1 for a missing one."""

    def among(least: int, most: int) -> str:
        if least == most:
            return str(least)
        middle = (least + most) // 2
        return f"IF({value} <= {double_sql(cuts[middle])}, {among(least, middle)}, {among(middle + 1, most)})"

    return f"IF({value} IS NULL OR isnan({value}), -1, {among(0, len(cuts))})"


def _best_cuts(rows: DataFrame, node: str, penalty: float, least_gain: float, least_hessian: float) -> DataFrame:
    """For each node the cut with the greatest gain over ``least_gain``, with the sums of both sides. Ties: the smallest
    feature, bin, and missing values to the left."""
    sums = (
        rows.selectExpr(f"{node} AS node", "g", "h", "posexplode(bins) AS (feature, bin)")
        .where("node IS NOT NULL")
        .groupBy("node", "feature", "bin")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = {c: F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col(c))).over(whole), F.lit(0.0)) for c in "gh"}
    known = {c: F.sum(F.when(F.col("bin") >= 0, F.col(c))).over(upto) for c in "gh"}
    table = sums.select("node", "feature", "bin", *[F.sum(c).over(whole).alias(f"all_{c}") for c in "gh"],
                        *[missing[c].alias(f"none_{c}") for c in "gh"], *[known[c].alias(f"low_{c}") for c in "gh"])
    sides = table.where("bin >= 0").selectExpr(
        "*", "inline(array(struct(true AS missing_left, low_g + none_g AS g1, low_h + none_h AS h1), struct(false AS missing_left, low_g AS g1, low_h AS h1)))"
    ).selectExpr("node", "feature", "bin", "missing_left", "g1", "h1", "all_g - g1 AS g2", "all_h - h1 AS h2", "all_g", "all_h")
    value = "{0} * {0} / ({1} + " + double_sql(penalty) + ")"
    gain = f"0.5D * ({value.format('g1', 'h1')} + {value.format('g2', 'h2')} - {value.format('all_g', 'all_h')})"
    open_ = sides.where(f"h1 >= {double_sql(least_hessian)} AND h2 >= {double_sql(least_hessian)}").selectExpr("*", f"{gain} AS gain")
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"), F.col("missing_left"))
    best = F.max_by(F.struct("feature", "bin", "missing_left", "gain", "g1", "h1", "g2", "h2"), order)
    return open_.where(f"gain > {double_sql(least_gain)}").groupBy("node").agg(best.alias("c"))


def fit_newton_boosting(
    train: DataFrame,
    spec: CustomerTable,
    rounds: int = 20,
    depth: int = 3,
    rate: float = 0.3,
    penalty: float = 1.0,
    least_gain: float = 0.0,
    least_hessian: float = 1e-3,
    max_bins: int = 32,
    preparation: Preparation | None = None,
) -> NewtonBoosting:
    """Boosted trees with Newton leaf weights -G / (H + ``penalty``), shrunk by ``rate``.

    A node is cut where the gain 1/2 (Gl²/(Hl + penalty) + Gr²/(Hr + penalty) - G²/(H + penalty)) is greatest, if it is above
    ``least_gain`` and both sides hold a Hessian of ``least_hessian``. Missing inputs are kept missing, and every cut
    learns their side; the default preparation fills nothing and scales nothing. Rows without label are left out; without
    any row, or with one class only, the model is its base margin.
    """
    preparation = preparation or fit_preparation(train, spec, scaled=False, fill_missing=False)
    label = F.col(quoted(spec.label))
    names = [f"x_{i}" for i in range(len(preparation.features))]
    inputs = train.where(label.isNotNull()).select(
        label.cast("double").alias("y"), *[F.expr(e).alias(n) for e, n in zip(preparation.expressions, names)]
    )
    n, mean = inputs.agg(F.count("*"), F.avg("y")).first()
    if not n or mean in (0.0, 1.0):
        base = 0.0 if not n else math.copysign(20.0, mean - 0.5)
        return NewtonBoosting(preparation, base, [], [])
    base = math.log(mean / (1 - mean))
    cuts = feature_cuts(inputs, names, max_bins)
    bins = ", ".join(bin_sql(n, c) for n, c in zip(names, cuts))
    rows = staged(inputs.selectExpr("y", f"array({bins}) AS bins", f"{double_sql(base)} AS margin"), "boosting")
    loss = "avg(ln(1D + exp(-abs(margin))) + greatest(margin, 0D) - y * margin)"
    trees, losses = [], [rows.selectExpr(f"{loss} AS l").first()[0]]
    for _ in range(rounds):
        slopes = rows.selectExpr("*", "1D / (1D + exp(-margin)) AS p").selectExpr("y", "bins", "p - y AS g", "p * (1D - p) AS h")
        splits: dict[int, Split] = {}
        sums: dict[int, tuple[float, float]] = {}
        level = [1]
        for step in range(depth):
            reached = Tree(splits, {}, {}).node_sql()
            node = f"CASE WHEN {reached} IN ({', '.join(map(str, level))}) THEN {reached} END"
            found = _best_cuts(slopes, node, penalty, least_gain, least_hessian).collect()  # a row for each open node
            level = []
            for r in found:
                c = r["c"]
                cut = [*cuts[c["feature"]], math.inf][c["bin"]]  # beyond the last one: known values against missing ones
                splits[r["node"]] = Split(c["feature"], c["bin"], cut, c["missing_left"], c["gain"])
                sums[2 * r["node"]], sums[2 * r["node"] + 1] = (c["g1"], c["h1"]), (c["g2"], c["h2"])
                level += [2 * r["node"], 2 * r["node"] + 1]
            if not level:
                break
        if not splits:
            break
        leaves = {m: s for m, s in sums.items() if m not in splits}
        tree = Tree(splits, {m: -rate * g / (h + penalty) for m, (g, h) in leaves.items()}, leaves)
        rows = staged(rows.selectExpr("y", "bins", f"margin + {tree.weight_sql()} AS margin"), "boosting")
        trees.append(tree)
        losses.append(rows.selectExpr(f"{loss} AS l").first()[0])
    return NewtonBoosting(preparation, base, trees, losses)
