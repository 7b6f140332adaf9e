import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import forest_shap as forest
from churnlake.operators.deep_forest import best_split, fit_deep_forest
from churnlake.operators.models import fit_model
from churnlake.schema import BANK_TABLE as SPEC


def outputs(found, rows):
    inputs = forest.feature_rows(found, rows, SPEC.id)
    return inputs, forest.forest_output(inputs, found.leaves, SPEC.id, found.preparation.features)


@pytest.mark.parametrize("node_rows", [100_000, 300])
def test_leaves_are_pure_or_cannot_be_split(bank, node_rows):
    rows = bank.where("CustomerId % 4 = 0").withColumn("Exited", F.when(F.col("CustomerId") % 97 != 0, F.col("Exited")))
    known = rows.where("Exited IS NOT NULL")
    found = fit_deep_forest(rows, SPEC, trees=3, bootstrap=False, node_rows=node_rows, max_bins=32)
    per_tree = found.leaves.groupBy("tree").agg(F.sum("rows").alias("n"), F.count("*").alias("k")).collect()
    assert [r["n"] for r in per_tree] == [known.count()] * 3 and min(r["k"] for r in per_tree) > 50
    inputs, scored = outputs(found, known)
    names = [f"`{n}`" for n in found.preparation.features]
    told = inputs.select(SPEC.id, F.expr(found.bins_sql(names)).alias("bins")).join(known.select(SPEC.id, "Exited"), SPEC.id).join(scored, SPEC.id)
    table = told.withColumn("key", F.col("bins").cast("string")).toPandas()
    share = table.groupby("key")["Exited"].transform("mean")
    assert np.allclose(table["output"], share, atol=1e-9)
    assert max(len(r["path"]) for r in found.leaves.collect()) > 3


def test_it_predicts_and_explains(bank):
    train, test = bank.where("CustomerId % 5 <> 0"), bank.where("CustomerId % 5 = 0")
    found = fit_deep_forest(train, SPEC, trees=20)
    inputs, scored = outputs(found, test)
    right = scored.join(test.select(SPEC.id, "Exited"), SPEC.id).agg(F.avg(((F.col("output") > 0.5) == (F.col("Exited") == 1)).cast("double"))).first()[0]
    limited = fit_model(train, SPEC, "random_forest", numTrees=20).score(test).agg(F.avg((F.col("prediction") == F.col("Exited")).cast("double"))).first()[0]
    assert right > 0.82 and right > limited - 0.03
    weights = found.leaves.groupBy("tree").agg(F.sum("rows").alias("n")).agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert 0.58 * 8000 < weights[0] and weights[1] < 0.68 * 8000 and weights[2] > 10  # each tree draws its own rows
    few = inputs.limit(20)
    names = found.preparation.features
    base = forest.forest_base_value(inputs, found.leaves, names)
    sums = forest.forest_shap(few, inputs, found.leaves, SPEC.id, names).groupBy(SPEC.id).agg(F.sum("shap_value").alias("s"))
    gap = sums.join(scored, SPEC.id).agg(F.max(F.abs(F.col("s") + base - F.col("output"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 20


def test_alike_rows_and_no_rows(bank):
    alike = bank.where("CustomerId % 20 = 0").withColumns({c: F.lit(1.0) for c in SPEC.numeric} | {c: F.lit("a") for c in SPEC.categorical})
    alike = alike.withColumn(SPEC.numeric[0], F.when(F.col("CustomerId") % 40 == 0, 2.0).otherwise(1.0))
    found = fit_deep_forest(alike, SPEC, trees=2, bootstrap=False, node_rows=10)
    assert found.leaves.count() == 4 and found.leaves.agg(F.sum("rows")).first()[0] == 2 * alike.count()
    assert fit_deep_forest(bank.where("false"), SPEC, trees=2, preparation=found.preparation).leaves.count() == 0


def test_best_split_by_hand():
    weight = np.array([[4.0, 4.0, 0.0], [0.0, 8.0, 0.0]])
    positive = np.array([[4.0, 0.0, 0.0], [0.0, 4.0, 0.0]])
    assert best_split(weight, positive, np.array([1, 0]), 1) == (0, 0)  # the first feature in order has one bin only
    assert best_split(weight[1:], positive[1:], np.array([0]), 1) is None


def test_levels_write_no_rows_and_rows_travel_once_a_tree(bank, monkeypatch):
    from churnlake.operators import deep_forest

    kept, staged = [], deep_forest.staged

    def counted(df, label="stage"):
        kept.append((label, staged(df, label)))
        return kept[-1][1]

    monkeypatch.setattr(deep_forest, "staged", counted)
    rows = bank.where("CustomerId % 8 = 0")
    found = fit_deep_forest(rows, SPEC, trees=3, bootstrap=False, node_rows=200, max_bins=32)
    assert sum(df.count() for label, df in kept if "leaves" not in label and "forest" not in label) == rows.count()
    inputs = forest.feature_rows(found, rows, SPEC.id)
    names = found.preparation.features
    whole = forest.forest_output(inputs, found.leaves.drop("cell"), SPEC.id, names).toPandas().set_index(SPEC.id)["output"]
    celled = forest.forest_output(inputs, found.leaves, SPEC.id, names, leaf_limit=50, block_rows=300).toPandas().set_index(SPEC.id)["output"]
    assert len(celled) == rows.count() and np.allclose(celled.sort_index(), whole.sort_index(), atol=1e-12)
    assert found.leaves.select("tree", "cell").distinct().count() > 10
