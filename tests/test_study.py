"""The whole study on the planted bank, from its CSV file."""

from churnlake.plans.study import run_study
from churnlake.session import new_path
from churnlake.sources.files import read_customers, write_customers


def test_study_from_csv(spark, bank):
    path = new_path(spark, "customers")
    write_customers(bank, path)
    small = {
        "random_forest": {"numTrees": 8, "maxDepth": 6},
        "gradient_boosting": {"maxIter": 4},
        "boosted_deep": {"maxIter": 2, "maxDepth": 4},
    }
    results = run_study(read_customers(spark, path), settings=small)
    sizes = {name: table.count() for name, table in results.items()}
    assert min(sizes.values()) > 0
    assert sizes["model_comparison"] == 5 and sizes["scored"] == 5 * 2000
    assert sizes["threshold_reports"] == 4 * 5 and sizes["shap_values"] == 100 * 11
    assert results["shap_importance"].orderBy("importance", ascending=False).first()["feature"] in ("Age", "NumOfProducts")
    assert results["gain"].orderBy("decile").first()["lift"] > 2
