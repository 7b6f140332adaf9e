"""The whole churn study in one call: a customer table in, a folder of result tables out.

    python -m churnlake.plans.study customers.csv results/
"""

from __future__ import annotations

import sys
from functools import reduce
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import curves, explain, folds, metrics, models, profile, scoring
from churnlake.operators import forest_shap as forest
from churnlake.operators.prep import add_derived
from churnlake.operators.split import stratified_split, uniform_sample
from churnlake.schema import BANK_TABLE, CustomerTable
from churnlake.session import drop_staged, get_spark, staged
from churnlake.sources.files import read_customers


def describe_customers(customers: DataFrame, spec: CustomerTable) -> dict[str, DataFrame]:
    """Profiling tables of a customer table."""
    return {
        "column_info": profile.column_info(customers),
        "describe": profile.describe(customers, [*spec.numeric, spec.label]),
        "null_counts": profile.null_counts(customers),
        "constant_columns": profile.constant_columns(customers),
        "class_distribution": profile.class_shares(customers, spec.label),
        "segment_churn": profile.segment_churn(customers, spec.label, spec.categorical),
        "histogram": profile.histogram(customers, spec.numeric),
        "violin_summary": profile.violin_summary(customers, spec.numeric, spec.label),
        "violin_density": reduce(
            DataFrame.unionByName,
            [
                profile.violin_density(customers, c, spec.label).withColumn("column", F.lit(c))
                for c in spec.numeric
            ],
        ),
        "correlation": profile.correlation(customers, [*spec.numeric, spec.label]),
        "derived_features": add_derived(customers, spec).select(
            spec.id, "BalanceSalaryRatio", "ProductDensity", "EngagementScore", "AgeTenure"
        ),
    }


def encoded_correlation(rows: DataFrame, spec: CustomerTable, preparation: models.Preparation) -> DataFrame:
    """Correlation of the model inputs, encoded and scaled, with each other and the label."""
    made = [F.expr(e).alias(n) for n, e in zip(preparation.features, preparation.expressions)]
    return profile.correlation(rows.select(*made, spec.label), [*preparation.features, spec.label])


def evaluate_models(scored: DataFrame, main: str) -> dict[str, DataFrame]:
    """Comparison of all models, and the threshold study of the main one."""
    rates = metrics.with_rates(metrics.outcome_counts(scored, ["model"]))
    chosen = scored.where(F.col("model") == main)
    sweep = metrics.threshold_counts(chosen)
    sweep_rates = metrics.with_rates(sweep)
    return {
        "model_comparison": metrics.compare_models(rates, curves.roc_auc(scored, ["model"])),
        "confusion_matrix": metrics.confusion_matrix(metrics.outcome_counts(chosen)),
        "classification_report": metrics.classification_report(metrics.outcome_counts(chosen)),
        "threshold_reports": metrics.classification_report(sweep, ["threshold"]),
        "threshold_steps": metrics.threshold_steps(sweep_rates),
        "operating_threshold": metrics.best_threshold(sweep_rates),
        "roc": curves.roc_with_diagonal(scored),
    }


def explain_forest(
    fitted: models.Fitted, test: DataFrame, spec: CustomerTable, dependence: Sequence[str], sample_size: int = 100
) -> dict[str, DataFrame]:
    """Importances, Shapley tables of a sample explained against itself, partial dependence."""
    spark = test.sparkSession
    names = fitted.preparation.features
    leaves = forest.leaf_table(spark, fitted.learner)
    sample = staged(uniform_sample(test, spec.id, sample_size), "sample")
    rows = forest.feature_rows(fitted, sample, spec.id)
    base = forest.forest_base_value(rows, leaves, names)
    shap = staged(forest.forest_shap(rows, rows, leaves, spec.id, names), "shap")
    first_id = sample.agg(F.min(spec.id)).first()[0]
    inputs = staged(forest.feature_rows(fitted, test, spec.id), "inputs")
    grids = explain.dependence_grid(inputs, [c for c in dependence if c in names])
    importance = explain.feature_importance(fitted.learner, names)
    return {
        "feature_importance": explain.top_features(importance),
        "importance_concentration": explain.importance_concentration(importance),
        "shap_values": shap,
        "shap_importance": explain.shap_importance(shap),
        "shap_summary": explain.beeswarm(shap, spec.id),
        "waterfall": explain.waterfall(shap, spec.id, base, first_id),
        "partial_dependence": forest.forest_partial_dependence(inputs, leaves, names, grids),
    }


def run_study(
    customers: DataFrame,
    spec: CustomerTable = BANK_TABLE,
    dependence: Sequence[str] = ("Age", "Balance", "NumOfProducts"),
    settings: Mapping[str, Mapping[str, object]] | None = None,
    model_path: str | None = None,
    grid: Sequence[Mapping[str, object]] = ({"maxDepth": 3}, {"maxDepth": 5}, {"maxDepth": 8}),
) -> dict[str, DataFrame]:
    """Profile, split, fit five models, compare, study thresholds, explain the forest, band the risk.

    ``settings`` overrides learner parameters by model kind. All models are saved to
    ``model_path`` as one artifact. ``grid`` lists the settings of a tree that are tried by cross-validation.
    """
    customers = staged(customers, "customers")
    rows = staged(stratified_split(customers, spec.label, spec.id), "split")
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    preparation = models.fit_preparation(train, spec)
    laid_out = models.training_table(train, spec)
    fitted = {
        kind: models.fit_model(train, spec, kind, preparation, laid_out=laid_out, **(settings or {}).get(kind, {}))
        for kind in models.MODEL_KINDS
    }
    if model_path:
        models.save_models(fitted, model_path)
    scored = staged(models.scored_table(fitted, test, spec), "scored")
    main = scored.where(F.col("model") == "random_forest")
    trees = {k: f for k, f in fitted.items() if k != "logistic_regression"}
    return {
        **describe_customers(customers, spec),
        "split_distribution": profile.split_shares(rows, spec.label, "split"),
        "majority_baseline": models.majority_baseline(train, test, spec.label),
        "cross_validation": folds.cross_validate(customers, spec),
        "tuning": folds.search(customers, spec, "decision_tree", grid),
        "encoded_correlation": encoded_correlation(train, spec, preparation),
        "scored": scored,
        **evaluate_models(scored, "random_forest"),
        **explain_forest(fitted["random_forest"], test, spec, dependence),
        "key_drivers": scoring.key_drivers(
            {k: explain.feature_importance(f.learner, f.preparation.features) for k, f in trees.items()}
        ),
        "risk_scores": scoring.risk_scores(main, spec.id),
        "high_risk": scoring.high_risk_list(main, spec.id),
        "gain": curves.gain_table(main, spec.id),
        "retention_targets": scoring.retention_targets(
            main.join(test.select(spec.id, spec.active), spec.id), spec.id, spec.active, 100
        ),
        "scenarios": scoring.scenario_summary(
            scoring.scenario_scores(
                scoring.align_customers(test, spec),
                {"everyone active": {spec.active: 1}, "one more product": {spec.products: 2}},
                fitted["random_forest"].score,
                spec.id,
            )
        ),
    }


def main(source: str, target: str) -> None:
    spark = get_spark("churn study")
    kind = "parquet" if source.rstrip("/").endswith("parquet") else "csv"
    results = run_study(read_customers(spark, source, source=kind), model_path=f"{target}/model")
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{target}/{name}")
    drop_staged(spark)


if __name__ == "__main__":
    main(*sys.argv[1:3])
