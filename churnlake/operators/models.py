"""Classifiers: preparation and learner in one saveable pipeline, fitted and applied by Spark ML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.expressions import quoted, ratio, text_sql
from churnlake.operators.prep import dummy_name, fit_imputation, fit_levels
from churnlake.schema import CustomerTable
from churnlake.session import ordered_by, staged, use_checkpoints

MODEL_KINDS = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "boosted_deep")


def make_classifier(kind: str, n_train: int, seed: int = 42, **settings):
    """A learner with the defaults this library compares; ``settings`` override them.

    The logistic penalty is 1/n because Spark averages the loss the penalty is weighed against.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    trees = {**common, "maxBins": 256, "seed": seed}
    if kind == "logistic_regression":
        options = {**common, "regParam": 1.0 / n_train, "elasticNetParam": 0.0, "standardization": False, "maxIter": 1000}
        return LogisticRegression(**{**options, **settings})
    if kind == "decision_tree":
        return DecisionTreeClassifier(**{**trees, "maxDepth": 5, "impurity": "gini", **settings})
    if kind == "random_forest":
        options = {"numTrees": 100, "featureSubsetStrategy": "sqrt", "maxDepth": 12}
        return RandomForestClassifier(**{**trees, **options, **settings})
    if kind == "gradient_boosting":
        return GBTClassifier(**{**trees, "maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **settings})
    if kind == "boosted_deep":
        return GBTClassifier(**{**trees, "maxIter": 100, "maxDepth": 6, "stepSize": 0.3, **settings})
    raise ValueError(f"unknown model {kind}")


@dataclass(frozen=True)
class Preparation:
    """Fitted preparation: one SQL expression per feature, in training order."""

    spec: CustomerTable
    features: tuple[str, ...]
    expressions: tuple[str, ...]

    def stages(self) -> list:
        columns = [f"x_{i}" for i in range(len(self.features))]
        made = ", ".join(f"{e} AS {c}" for e, c in zip(self.expressions, columns))
        return [
            SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"),
            VectorAssembler(inputCols=columns, outputCol="features"),
        ]


def raw_expressions(
    spec: CustomerTable, levels: Mapping[str, Sequence[str]], fills: Mapping[str, object], feature_set: str
) -> dict[str, str]:
    def number(column: str) -> str:
        fill, value = fills.get(column), f"CAST({quoted(column)} AS DOUBLE)"
        return value if fill is None else f"COALESCE({value}, {float(fill)!r}D)"

    made = {c: number(c) for c in spec.numeric}
    for column, values in levels.items():
        fill = fills.get(column)
        value = quoted(column) if fill is None else f"COALESCE({quoted(column)}, {text_sql(str(fill))})"
        for level in values[1:]:
            name = dummy_name(column, level)
            if name in made:
                raise ValueError(f"two features would have the name {name}")
            made[name] = f"CASE WHEN {value} = {text_sql(str(level))} THEN 1.0D ELSE 0.0D END"
    if feature_set == "extended":
        balance, salary, products, tenure, active = (
            number(c) for c in (spec.balance, spec.salary, spec.products, spec.tenure, spec.active)
        )
        made["BalanceSalaryRatio"] = f"COALESCE(TRY_DIVIDE({balance}, {salary} + 1), 0.0D)"
        made["ProductDensity"] = f"COALESCE(TRY_DIVIDE({products}, {tenure} + 1), 0.0D)"
        made["EngagementScore"] = f"{active} * {products}"
        made["AgeTenure"] = f"{number(spec.age or spec.products)} * {tenure}"
    elif feature_set != "base":
        raise ValueError("feature_set is 'base' or 'extended'")
    return made


def fit_preparation(
    train: DataFrame,
    spec: CustomerTable,
    levels: Mapping[str, Sequence[str]] | None = None,
    feature_set: str = "base",
    scaled: bool = True,
    drop_constant: bool = True,
    fill_missing: bool = True,
    level_limit: int = 1000,
) -> Preparation:
    """Learn levels, fills and scaling from the training rows only.

    Missing numbers become the median and missing categories the most frequent level of the training rows;
    without ``fill_missing`` a missing number is an error of the learner. ``level_limit``: see ``fit_levels``.
    """
    levels = levels or fit_levels(train, spec.categorical, level_limit)
    fills = fit_imputation(train, spec.numeric, spec.categorical) if fill_missing else {}
    raw = raw_expressions(spec, levels, fills, feature_set)
    row = train.agg(
        *[
            F.expr(f"{f}({e}) AS {short}{i}")
            for i, e in enumerate(raw.values())
            for short, f in (("m", "avg"), ("d", "stddev_pop"), ("lo", "min"), ("hi", "max"))
        ]
    ).first()
    names, made = [], []
    for i, (name, e) in enumerate(raw.items()):
        constant = row[f"lo{i}"] == row[f"hi{i}"]
        if drop_constant and constant:
            continue
        names.append(name)
        if scaled:
            deviation = 1.0 if constant else float(row[f"d{i}"] or 1.0)
            e = f"(({e}) - {float(row[f'm{i}'] or 0.0)!r}D) / {deviation!r}D"
        made.append(e)
    return Preparation(spec, tuple(names), tuple(made))


def training_rows(df: DataFrame, spec: CustomerTable) -> DataFrame:
    """Labelled rows in a layout that depends on ids and the number of cores only, so bootstrap samples repeat."""
    label = F.col(quoted(spec.label)).cast("double").alias("label")
    known = df.where(F.col(quoted(spec.label)).isNotNull())
    columns = [F.col(quoted(c)) for c in (spec.id, *spec.numeric, *spec.categorical)]
    return ordered_by(known.select(*columns, label), F.col(quoted(spec.id)))


def training_table(df: DataFrame, spec: CustomerTable) -> DataFrame:
    """``training_rows`` written once, for any number of fits."""
    return staged(training_rows(df, spec), "training")


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline with the feature names behind its vector."""

    kind: str
    preparation: Preparation
    pipeline: PipelineModel

    @property
    def learner(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame) -> DataFrame:
        return with_score(self.pipeline.transform(df))


def with_score(transformed: DataFrame) -> DataFrame:
    """The class-1 probability as a plain column."""
    return transformed.withColumns(
        {
            "score": vector_to_array(F.col("probability"))[1],
            "prediction": F.col("prediction").cast("int"),
        }
    )


def fit_model(
    train: DataFrame,
    spec: CustomerTable,
    kind: str,
    preparation: Preparation | None = None,
    seed: int = 42,
    feature_set: str = "base",
    scaled: bool = True,
    drop_constant: bool = True,
    fill_missing: bool = True,
    laid_out: DataFrame | None = None,
    **settings,
) -> Fitted:
    """``laid_out``: the ``training_table`` of ``train``, where several models are fitted to the same rows."""
    preparation = preparation or fit_preparation(
        train, spec, feature_set=feature_set, scaled=scaled, drop_constant=drop_constant, fill_missing=fill_missing
    )
    use_checkpoints(train.sparkSession)
    rows = training_table(train, spec) if laid_out is None else laid_out
    n_train = rows.count() if kind == "logistic_regression" else 0
    learner = make_classifier(kind, max(n_train, 1), seed, **settings)
    pipeline = Pipeline(stages=[*preparation.stages(), learner]).fit(rows)
    return Fitted(kind, preparation, pipeline)


def scored_table(models: Mapping[str, Fitted], df: DataFrame, spec: CustomerTable) -> DataFrame:
    """One long table (id, label, model, score, prediction) over several models."""
    parts = [
        fitted.score(df).select(
            spec.id, F.col(spec.label).cast("int").alias("label"), F.lit(name).alias("model"), "score", "prediction"
        )
        for name, fitted in models.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Accuracy of always predicting the most frequent training class."""
    top = train.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()
    guess = top[0] if top else None
    return test.agg(
        F.lit(guess).cast("int").alias("predicted_class"),
        F.count(F.col(label)).alias("n"),
        ratio(F.count_if(F.col(label) == F.lit(guess)), F.count(F.col(label))).alias("accuracy"),
    )


def save_models(fitted: Mapping[str, Fitted], path: str) -> None:
    """One artifact of several models: their pipelines, and a table of kinds, features and expressions."""
    spark = SparkSession.active()
    rows = []
    for name, model in fitted.items():
        model.pipeline.write().overwrite().save(f"{path}/pipelines/{name}")
        preparation = model.preparation
        spec = json.dumps(asdict(preparation.spec))
        for i, (feature, expression) in enumerate(zip(preparation.features, preparation.expressions)):
            rows.append((name, model.kind, spec, i, feature, expression))
    kind = "name string, kind string, spec string, position int, feature string, expression string"
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_models(spark: SparkSession, path: str) -> dict[str, Fitted]:
    """The models of an artifact, as they were fitted: they score, and explain, like the originals."""
    rows: dict[str, list] = {}
    for row in spark.read.parquet(f"{path}/features").orderBy("name", "position").collect():
        rows.setdefault(row["name"], []).append(row)
    found = {}
    for name, features in rows.items():
        spec = json.loads(features[0]["spec"])
        spec = CustomerTable(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})
        names, made = zip(*((r["feature"], r["expression"]) for r in features))
        pipeline = PipelineModel.load(f"{path}/pipelines/{name}")
        found[name] = Fitted(features[0]["kind"], Preparation(spec, names, made), pipeline)
    return found


def save_model(fitted: Fitted, path: str) -> None:
    save_models({"model": fitted}, path)


def load_model(spark: SparkSession, path: str) -> Fitted:
    return load_models(spark, path)["model"]


def save_features(spark: SparkSession, features: Sequence[str], path: str) -> None:
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("position").collect()]
