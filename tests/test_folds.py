import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import folds, models
from churnlake.operators.prep import fit_levels
from churnlake.schema import BANK_TABLE as SPEC


def with_holes(bank):
    return bank.withColumns(
        {
            "Age": F.when(F.col("CustomerId") % 7 != 0, F.col("Age")),
            "Geography": F.when(F.col("CustomerId") % 11 != 0, F.col("Geography")),
            "Exited": F.when(F.col("CustomerId") % 97 != 0, F.col("Exited")),
        }
    )


@pytest.mark.parametrize("holes", [False, True])
def test_merged_statistics_equal_a_fit_of_the_training_rows(bank, holes):
    table = folds.fold_table(with_holes(bank) if holes else bank, SPEC, 4)
    levels = fit_levels(table.rows, SPEC.categorical)
    for k, made in table.preparations.items():
        train = table.rows.where(F.col("fold") != k)
        plain = models.fit_preparation(train, SPEC, levels)
        assert made.features == plain.features and train.count() == table.training_size(k)
        gaps = [F.max(F.abs(F.expr(a) - F.expr(b))) for a, b in zip(made.expressions, plain.expressions)]
        assert max(table.rows.agg(*gaps).first()) < 1e-9


@pytest.mark.parametrize("scaled", [True, False])
def test_shared_newton_steps_reach_the_learner_of_each_fold(bank, scaled):
    table = folds.fold_table(with_holes(bank), SPEC, 3, scaled)
    settings = [{}, {"regParam": 0.1}]
    weights = folds.fit_logistic_folds(table, settings)
    for (s, k), w in weights.items():
        preparation = table.preparations[k]
        rows = table.rows.where(F.col("fold") != k).selectExpr(*[f"{e} AS x{i}" for i, e in enumerate(preparation.expressions)], "label").toPandas()
        x, y = np.column_stack((rows.drop(columns="label").to_numpy(), np.ones(len(rows)))), rows["label"].to_numpy()
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.full(w.size, settings[s].get("regParam", 1 / len(rows)) * len(rows))
        penalty[-1] = 0
        gradient = x.T @ (p - y) + penalty * w
        assert np.abs(gradient / np.maximum(1, np.abs(x).max(0))).max() < 1e-3 * len(rows) ** 0.5


def test_predictions_agree_with_the_library(bank):
    table = folds.fold_table(bank, SPEC, 3)
    ours = folds.fold_predictions(table, "logistic_regression", [{}])
    assert ours.count() == 10000 and ours.where("prediction IS NULL").isEmpty()
    own = folds.fold_predictions(table, "logistic_regression", [{"fitIntercept": True}])  # fold by fold
    differ = ours.join(own.withColumnRenamed("prediction", "other"), SPEC.id).where("prediction <> other").count()
    assert differ <= 2


def test_halving_keeps_the_best_of_each_rung(bank):
    grid = [{"maxDepth": d} for d in (1, 2, 3, 5)]
    found = folds.halving_search(bank, SPEC, "decision_tree", grid, folds=2, factor=2, rungs=3)
    rungs = found.rungs.toPandas()
    assert rungs.groupby("rung").size().tolist() == [4, 2, 1]
    assert rungs.groupby("rung")["rows"].first().tolist()[2] == 10000
    shares = rungs.groupby("rung")["rows"].first() / 10000
    assert abs(shares[0] - 0.25) < 0.03 and abs(shares[1] - 0.5) < 0.03
    for _, rung in rungs.groupby("rung"):
        assert rung[rung.kept].mean_accuracy.min() >= rung[~rung.kept].mean_accuracy.max() or rung.kept.all()
    assert found.winner in grid


def test_empty_grid_is_refused(bank):
    with pytest.raises(ValueError):
        folds.halving_search(bank, SPEC, "decision_tree", [])
