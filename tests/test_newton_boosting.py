import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import models
from churnlake.operators.newton_boosting import bin_sql, fit_newton_boosting
from churnlake.schema import BANK_TABLE as SPEC


@pytest.fixture(scope="module")
def rows(bank):
    return bank.where("CustomerId % 3 = 0").withColumns(
        {
            "Age": F.when(F.col("CustomerId") % 5 != 0, F.col("Age")),
            "Balance": F.when(F.col("Exited") + F.col("CustomerId") % 4 > 0, F.col("Balance")),
            "Exited": F.when(F.col("CustomerId") % 101 != 0, F.col("Exited")),
        }
    )


def inputs(model, rows):
    table = rows.where("Exited IS NOT NULL").selectExpr(*[f"{e} AS x{i}" for i, e in enumerate(model.preparation.expressions)], "Exited").toPandas()
    return table.drop(columns="Exited").to_numpy(dtype=float), table["Exited"].to_numpy(dtype=float)


def gain(g, h, side, penalty):
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    return 0.5 * (part(side) + part(~side) - part(np.ones(len(g), bool)))


def test_every_cut_is_the_best_one_and_every_weight_a_newton_step(rows):
    model = fit_newton_boosting(rows, SPEC, rounds=3, depth=2, rate=0.5, penalty=2.0, max_bins=16)
    x, y = inputs(model, rows)
    margin = np.full(len(y), model.base)
    assert model.base == pytest.approx(math.log(y.mean() / (1 - y.mean()))) and len(model.trees) == 3
    cuts = {}
    for tree in model.trees:
        for split in tree.splits.values():
            cuts.setdefault(split.feature, set()).add(split.cut)
    for r, tree in enumerate(model.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes, new = {1: np.ones(len(y), bool)}, margin.copy()
        for node, split in sorted(tree.splits.items()):
            here = nodes[node]
            low = np.where(np.isnan(x[:, split.feature]), split.missing_left, x[:, split.feature] <= split.cut).astype(bool)
            nodes[2 * node], nodes[2 * node + 1] = here & low, here & ~low
            assert split.gain == pytest.approx(gain(g[here], h[here], low[here], 2.0))
            for f, values in cuts.items():  # no other cut known to the model gains more
                for c in values:
                    for side in (True, False):
                        other = np.where(np.isnan(x[here, f]), side, x[here, f] <= c).astype(bool)
                        if min(h[here][other].sum(), h[here][~other].sum()) >= 1e-3:
                            assert gain(g[here], h[here], other, 2.0) <= split.gain + 1e-9
        for node, weight in tree.weights.items():
            m = nodes[node]
            assert weight == pytest.approx(-0.5 * g[m].sum() / (h[m].sum() + 2.0), abs=1e-9)
            new[m] += weight
        margin = new
        loss = (np.logaddexp(0, margin) - y * margin).mean()
        assert model.losses[r + 1] == pytest.approx(loss) and model.losses[r + 1] < model.losses[r]


def test_scores_follow_the_trees_and_learn(rows):
    model = fit_newton_boosting(rows, SPEC, rounds=10, depth=3)
    scored = model.score(rows.where("Exited IS NOT NULL"))
    right, n = scored.agg(F.count_if(F.col("prediction") == F.col("Exited")), F.count("*")).first()
    assert right / n > 0.85 and scored.where("score NOT BETWEEN 0 AND 1").isEmpty()
    assert any(s.missing_left for t in model.trees for s in t.splits.values())
    assert models.scored_table({"newton": model}, rows, SPEC).where("model = 'newton'").count() == rows.count()


def test_a_gain_that_is_asked_for_prunes(rows):
    assert fit_newton_boosting(rows, SPEC, rounds=2, depth=2, least_gain=1e9).trees == []


def test_one_class_and_no_rows(rows):
    one = fit_newton_boosting(rows.where("Exited = 1"), SPEC, rounds=2)
    assert one.trees == [] and one.score(rows).where("score < 0.99").isEmpty()
    none = fit_newton_boosting(rows.where("Exited IS NULL"), SPEC, rounds=2)
    assert none.score(rows).where("score <> 0.5").isEmpty()


def test_bins(spark):
    cuts = [1.0, 2.5, 7.0]
    got = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.5,), (7.0,), (9.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in got.selectExpr(bin_sql("v", cuts)).collect()] == [0, 0, 1, 1, 2, 3, -1, -1]
