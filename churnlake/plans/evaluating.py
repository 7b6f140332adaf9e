"""Registered queries: metrics, thresholds, curves, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import curves, metrics
from churnlake.operators.prep import apply_threshold
from churnlake.plans.inputs import ID, profile, rounded, score_rows, scored, with_models, with_scored
from churnlake.plans.registry import query
from churnlake.session import staged

CUT = 0.4

_COUNTS = f"""counts as (
  select model, count(*) filter (where label = 1 and score > {CUT}e0) as tp,
    count(*) filter (where label = 0 and score > {CUT}e0) as fp,
    count(*) filter (where label = 1 and not score > {CUT}e0) as fn,
    count(*) filter (where label = 0 and not score > {CUT}e0) as tn from scored group by model)"""

_ACCURACY = "cast(tp + tn as double) / (tp + tn + fp + fn)"
_PRECISION = "coalesce(cast(tp as double) / nullif(tp + fp, 0), 0)"
_RECALL = "coalesce(cast(tp as double) / nullif(tp + fn, 0), 0)"
_F1 = "coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_SPECIFICITY = "coalesce(cast(tn as double) / nullif(tn + fp, 0), 0)"


def _predicted(spark, folder):
    return scored(spark, folder).withColumn("prediction", apply_threshold(F.col("score"), CUT))


def _model_counts(spark, folder):
    return metrics.outcome_counts(_predicted(spark, folder), ["model"])


def _rate(name: str, expression: str) -> str:
    return with_models(f", {_COUNTS} select model, round({expression}, 6) as {name} from counts")


@query("e1_accuracy", _rate("accuracy", _ACCURACY))
def accuracy(spark, folder):
    return rounded(_model_counts(spark, folder).select("model", metrics.accuracy().alias("accuracy")))


@query("e2_precision", _rate("precision", _PRECISION))
def precision(spark, folder):
    return rounded(_model_counts(spark, folder).select("model", metrics.precision().alias("precision")))


@query("e3_recall", _rate("recall", _RECALL))
def recall(spark, folder):
    return rounded(_model_counts(spark, folder).select("model", metrics.recall().alias("recall")))


@query("e4_f1", _rate("f1", _F1))
def f1(spark, folder):
    return rounded(_model_counts(spark, folder).select("model", metrics.f1().alias("f1")))


_STEPS = """ties as (
  select model, score as threshold, cast(sum(label) as double) pos, cast(sum(1 - label) as double) neg
  from scored where score is not null group by model, score),
steps as (
  select *, sum(pos) over w cum_pos, sum(neg) over w cum_neg,
    sum(pos) over (partition by model) p, sum(neg) over (partition by model) n
  from ties window w as (partition by model order by threshold desc rows unbounded preceding)),
areas as (
  select model, sum(neg * (cum_pos - pos / 2)) / nullif(any_value(p) * any_value(n), 0) as auc from steps group by model)"""


@query("e5_roc_auc", with_models(f", {_STEPS} select model, round(auc, 6) as auc from areas"))
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(scored(spark, folder), ["model"]))


_CELLS = "(values (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)"


@query(
    "e6_confusion_matrix",
    with_models(
        f""", hits as (
  select model, label, cast(score > {CUT}e0 as int) pred, count(*) c from scored group by 1, 2, 3)
select m.model, g.actual, g.predicted, coalesce(c, 0) as n
from (select distinct model from scored) m cross join {_CELLS}
left join hits on hits.model = m.model and label = actual and pred = predicted"""
    ),
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_model_counts(spark, folder), ["model"])


@query(
    "e7_outcomes_and_specificity",
    with_models(f", {_COUNTS} select model, tp, fp, fn, tn, round({_SPECIFICITY}, 6) as specificity from counts"),
)
def outcomes(spark, folder):
    counts = _model_counts(spark, folder)
    return rounded(counts.withColumn("specificity", metrics.specificity()))


_SWEEP = """sweep as (
  select model, t as threshold, count(*) filter (where label = 1 and score > t) as tp,
    count(*) filter (where label = 0 and score > t) as fp,
    count(*) filter (where label = 1 and not score > t) as fn,
    count(*) filter (where label = 0 and not score > t) as tn
  from scored, (values (0.5e0), (0.4e0), (0.3e0), (0.2e0)) g(t) group by model, t)"""


def _report(keys: str, source: str) -> str:
    class0 = (
        "coalesce(cast(tn as double) / nullif(tn + fn, 0), 0)",
        "coalesce(cast(tn as double) / nullif(tn + fp, 0), 0)",
        "coalesce(2e0 * tn / nullif(2 * tn + fn + fp, 0), 0)",
    )
    class1 = (_PRECISION, _RECALL, _F1)
    names = ("precision", "recall", "f1")

    def line(label, values, support):
        cells = ", ".join(f"round({v}, 6) as {n}" for v, n in zip(values, names))
        return f'select {keys}, \'{label}\' as "class", {cells}, cast({support} as bigint) as support from {source}'

    total = "(tp + fp + fn + tn)"
    macro = [f"({a} + {b}) / 2" for a, b in zip(class0, class1)]
    weighted = [f"({a} * (tn + fp) + {b} * (tp + fn)) / {total}" for a, b in zip(class0, class1)]
    none = "cast(null as double)"
    return "\nunion all\n".join(
        [
            line("0", class0, "tn + fp"),
            line("1", class1, "tp + fn"),
            line("accuracy", (none, none, f"cast(tp + tn as double) / {total}"), total),
            line("macro avg", macro, total),
            line("weighted avg", weighted, total),
        ]
    )


@query("e8_classification_report", with_models(f", {_COUNTS}\n{_report('model', 'counts')}"))
def classification_report(spark, folder):
    return rounded(metrics.classification_report(_model_counts(spark, folder), ["model"]))


@query("e9_threshold_sweep", with_models(f", {_SWEEP}\n{_report('model, threshold', 'sweep')}"))
def threshold_sweep(spark, folder):
    counts = metrics.threshold_counts(scored(spark, folder), by=["model"])
    return rounded(metrics.classification_report(counts, ["model", "threshold"]))


_RATES = f"rates as (select model, threshold, {_PRECISION} as precision, {_RECALL} as recall, {_F1} as f1 from sweep)"


@query(
    "e10_operating_threshold",
    with_models(
        f""", {_SWEEP}, {_RATES}
select model, threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from (
  select *, row_number() over (partition by model order by f1 desc, threshold desc) rn from rates
  where recall >= 0.3e0 and precision >= 0.05e0) where rn = 1"""
    ),
)
def operating_threshold(spark, folder):
    rates = metrics.with_rates(metrics.threshold_counts(scored(spark, folder), by=["model"]))
    return rounded(metrics.best_threshold(rates, ["model"], recall_floor=0.3, precision_floor=0.05))


_POINTS = """points as (
  select model, threshold, cast(cum_neg as bigint) as fp, cast(cum_pos as bigint) as tp,
    round(cum_neg / n, 6) as fpr, round(cum_pos / p, 6) as tpr from steps
  union all
  select distinct model, cast(null as double), cast(0 as bigint), cast(0 as bigint), 0e0, 0e0 from steps)"""


@query(
    "e11_roc_points",
    with_scored(f", {_STEPS}, {_POINTS} select threshold, fp, tp, fpr, tpr from points"),
)
def roc_points(spark, folder):
    return rounded(curves.roc_points(scored(spark, folder, "engagement")), 6, "fpr", "tpr")


@query(
    "e11_roc_corners",
    with_models(
        f""", {_STEPS}, numbered as (
  select *, row_number() over w rn, lead(pos) over w next_pos, lead(neg) over w next_neg from steps
  window w as (partition by model order by threshold desc))
select model, threshold, cast(cum_neg as bigint) as fp, cast(cum_pos as bigint) as tp, round(cum_neg / n, 6) as fpr,
  round(cum_pos / p, 6) as tpr from numbered where rn = 1 or next_pos is null or pos <> next_pos or neg <> next_neg
union all
select distinct model, cast(null as double), cast(0 as bigint), cast(0 as bigint), 0e0, 0e0 from steps"""
    ),
)
def roc_corners(spark, folder):
    points = curves.roc_points(scored(spark, folder), ["model"], drop_collinear=True)
    return rounded(points, 6, "fpr", "tpr")


@query(
    "e12_roc_by_model",
    with_models(
        f""", {_STEPS}, {_POINTS}
select model, threshold, fp, tp, fpr, tpr, round(auc, 6) as auc from points join areas using (model)
union all
select 'random', null, null, null, e, e, 0.5e0 from (values (0e0), (1e0)) v(e)"""
    ),
)
def roc_by_model(spark, folder):
    return rounded(curves.roc_with_diagonal(scored(spark, folder)), 6, "fpr", "tpr", "auc")


@query(
    "e13_model_comparison",
    with_models(
        f""", {_COUNTS}, {_STEPS}
select model, round({_ACCURACY}, 6) as accuracy, round({_PRECISION}, 6) as precision, round({_RECALL}, 6) as recall,
  round({_F1}, 6) as f1, round(auc, 6) as auc,
  cast(row_number() over (order by round({_ACCURACY}, 9) desc, model) as int) as place
from counts join areas using (model)"""
    ),
)
def model_comparison(spark, folder):
    rows = staged(_predicted(spark, folder), "scored")
    rates = metrics.with_rates(metrics.outcome_counts(rows, ["model"]))
    return rounded(metrics.compare_models(rates, curves.roc_auc(rows, ["model"])))


@query(
    "e14_threshold_steps",
    with_models(
        f""", {_SWEEP}, {_RATES}
select model, threshold, round(recall, 6) as recall, round(precision, 6) as precision,
  round(recall - lag(recall) over w, 6) + 0e0 as recall_change,
  round(precision - lag(precision) over w, 6) + 0e0 as precision_change
from rates window w as (partition by model order by threshold desc)"""
    ),
)
def threshold_steps(spark, folder):
    rates = metrics.with_rates(metrics.threshold_counts(scored(spark, folder), by=["model"]))
    return rounded(metrics.threshold_steps(rates, ["model"]))


@query(
    "b7_gain_table",
    with_scored(
        """, tiles as (
  select label, ntile(10) over (order by score desc, customer_id) as decile from scored
  where score is not null),
sums as (select decile, count(*) n, cast(sum(label) as bigint) churned from tiles group by decile),
base as (select cast(sum(label) as double) c, count(*) t from scored where score is not null)
select cast(decile as int) as decile, n, churned, round(cast(churned as double) / n, 6) as churn_rate,
  round((cast(churned as double) / n) / (c / t), 6) as lift,
  round(sum(churned) over (order by decile) / c, 6) as cumulative_gain
from sums, base"""
    ),
)
def gain_table(spark, folder):
    rows = staged(score_rows(profile(spark, folder), "engagement"), "scored")
    return rounded(curves.gain_table(rows, ID))
