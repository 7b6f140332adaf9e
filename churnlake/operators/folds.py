"""Cross-validation of all folds from shared passes, and a search that tries few settings on all rows.

Rows are laid out once. One pass tells, for each fold, counts, means, squared deviations and level counts; what a fold trains
on is the merger of the other folds' statistics, so its fills, scaling and constant columns cost no pass of their own.
Logistic regressions of all folds are fitted together: a Newton step of every fold is one job, in which each
partition adds up gradients and Hessians, and only their sums come back.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.expressions import double_sql, quoted, sample_key
from churnlake.operators.metrics import outcome_counts, with_rates
from churnlake.operators.models import Preparation, make_classifier, raw_expressions
from churnlake.operators.prep import dummy_name, fit_levels
from churnlake.operators.selection import exact_quantiles
from churnlake.operators.split import stratified_folds
from churnlake.schema import CustomerTable
from churnlake.session import ordered_by, staged, use_checkpoints

# Functions of this module travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the shared fit of logistic regressions knows; with other settings each fold is fitted by itself.
SHARED_SETTINGS = {"maxIter", "tol", "regParam"}


@dataclass(frozen=True)
class Moments:
    """Count, mean, squared deviations, least and greatest value; adds up over disjoint parts."""

    n: float = 0.0
    mean: float = 0.0
    deviations: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return Moments()
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * other.n / n,
            self.deviations + other.deviations + gap * gap * self.n * other.n / n,
            min(self.low, other.low),
            max(self.high, other.high),
        )


@dataclass(frozen=True)
class FoldTable:
    """Labelled rows (id, inputs, label, fold) as a table, and the preparation that each fold's training rows give."""

    rows: DataFrame
    spec: CustomerTable
    sizes: Mapping[int, int]
    preparations: Mapping[int, Preparation]

    def training_size(self, fold: int) -> int:
        return sum(self.sizes.values()) - self.sizes[fold]


def fold_table(df: DataFrame, spec: CustomerTable, folds: int = 5, scaled: bool = True) -> FoldTable:
    """Stratified folds in one layout that depends on ids and the number of cores only, with the preparations of all folds."""
    folded = stratified_folds(df, spec.label, spec.id, folds).where(F.col(quoted(spec.label)).isNotNull())
    columns = [F.col(quoted(c)) for c in (spec.id, *spec.numeric, *spec.categorical)]
    rows = folded.select(*columns, F.col(quoted(spec.label)).cast("double").alias("label"), "fold")
    rows = staged(ordered_by(rows, F.col(quoted(spec.id))), "folds")
    return with_preparations(rows, spec, fit_levels(df, spec.categorical), scaled)


def with_preparations(rows: DataFrame, spec: CustomerTable, levels: Mapping[str, Sequence[str]], scaled: bool = True) -> FoldTable:
    """The preparations of all folds of ``rows``, from one pass; columns with missing values take one selection of medians
    for all folds together."""
    flags = [(c, level) for c in spec.categorical for level in levels[c]]
    found = rows.groupBy("fold").agg(
        F.count("*").alias("rows"),
        *[F.expr(f"{f}(CAST({quoted(c)} AS double)) AS {s}{i}") for i, c in enumerate(spec.numeric)
          for s, f in (("n", "count"), ("m", "avg"), ("v", "var_pop"), ("l", "min"), ("h", "max"))],
        *[F.count_if(F.col(quoted(c)) == F.lit(level)).alias(f"f{i}") for i, (c, level) in enumerate(flags)],
        *[F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(spec.categorical)],
    ).collect()
    stats = {r["fold"]: r for r in found}
    sizes = {k: r["rows"] for k, r in stats.items()}
    holes = [c for i, c in enumerate(spec.numeric) if sum(r[f"n{i}"] for r in found) < sum(sizes.values())]
    series = {f"{k}|{c}": F.when(F.col("fold") != k, F.col(quoted(c)).cast("double")) for k in stats for c in holes}
    medians = exact_quantiles(rows, series, (0.5,)) if series else {}

    def preparation(fold: int) -> Preparation:
        others = [r for k, r in stats.items() if k != fold]
        n, fills, scales = sum(r["rows"] for r in others), {}, {}
        for i, c in enumerate(spec.numeric):
            parts = [Moments(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"] * r[f"n{i}"], r[f"l{i}"], r[f"h{i}"]) for r in others if r[f"n{i}"]]
            whole = sum(parts, Moments())
            if c in holes and medians[(f"{fold}|{c}", 0.5)] is not None:
                fills[c] = medians[(f"{fold}|{c}", 0.5)]
                if whole.n < n:
                    whole += Moments(n - whole.n, fills[c], 0.0, fills[c], fills[c])
            scales[c] = (whole.mean, math.sqrt(whole.deviations / whole.n) if whole.n else 0.0, whole.low >= whole.high)
        for i, c in enumerate(spec.categorical):
            counts = {level: sum(r[f"f{j}"] for r in others) for j, (column, level) in enumerate(flags) if column == c}
            missing = n - sum(r[f"c{i}"] for r in others)
            if counts and max(counts.values()) > 0:
                fills[c] = min(counts, key=lambda level: (-counts[level], level))
                counts[fills[c]] += missing
            for level, k in counts.items():
                share = k / n if n else 0.0
                scales[dummy_name(c, level)] = (share, math.sqrt(share * (1 - share)), k in (0, n))
        names, made = [], []
        for name, e in raw_expressions(spec, levels, fills, "base").items():
            mean, deviation, constant = scales[name]
            if constant:
                continue
            names.append(name)
            made.append(f"(({e}) - {mean!r}D) / {deviation or 1.0!r}D" if scaled else e)
        return Preparation(spec, tuple(names), tuple(made))

    return FoldTable(rows, spec, sizes, {k: preparation(k) for k in sorted(stats)})


def _newton_sums(rows: DataFrame, spec_of: Mapping[tuple[int, int], np.ndarray], widths: Mapping[int, int]) -> dict:
    """(loss, gradient, Hessian) of each model (setting, fold) at its weights: one job. ``rows``: fold, label and the
    features x<k> of each fold's preparation."""
    folds, models = sorted(widths), sorted(spec_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(1 + w.size + w.size**2) for m, w in spec_of.items()}
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in folds:
                mine = fold != k
                x = batch.column(2 + folds.index(k)).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), widths[k])[mine]
                x, y = np.column_stack((x, np.ones(len(x)))), label[mine]
                for m in models:
                    if m[1] != k:
                        continue
                    margin = x @ spec_of[m]
                    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                    loss = np.logaddexp(0, margin).sum() - (y * margin).sum()
                    hessian = (x * (p * (1 - p))[:, None]).T @ x
                    sums[m] += np.concatenate(([loss], x.T @ (p - y), hessian.ravel()))
        for m, values in sums.items():
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            columns = (np.full(len(values), m[0]), np.full(len(values), m[1]), np.arange(len(values)), values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["setting", "fold", "place", "value"])

    met = rows.mapInArrow(run, "setting int, fold int, place int, value double")
    table = met.groupBy("setting", "fold", "place").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    out = {m: np.zeros(1 + w.size + w.size**2) for m, w in spec_of.items()}
    for s, k, place, value in zip(table["setting"], table["fold"], table["place"], table["value"]):
        out[(s, k)][place] = value
    return {m: (v[0], v[1 : 1 + spec_of[m].size], v[1 + spec_of[m].size :].reshape(spec_of[m].size, -1)) for m, v in out.items()}


def fit_logistic_folds(table: FoldTable, settings: Sequence[Mapping[str, object]]) -> dict[tuple[int, int], np.ndarray]:
    """Weights and intercept (last) of each (setting, fold): the minimum of the mean log-loss plus half of regParam times
    the squared weights, by damped Newton steps, all models in one job a step. regParam is 1 / n unless it is set."""
    widths = {k: len(p.features) for k, p in table.preparations.items()}
    vectors = [f"array({', '.join(p.expressions) or 'CAST(NULL AS double)'}) AS x{k}" for k, p in table.preparations.items()]
    rows = staged(table.rows.selectExpr("fold", "label", *vectors), "vectors")
    weights = {(s, k): np.zeros(widths[k] + 1) for s in range(len(settings)) for k in widths}
    best = {m: (math.inf, w, np.zeros_like(w)) for m, w in weights.items()}
    rounds = dict.fromkeys(weights, 0)
    active = set(weights)
    while active:
        sums = _newton_sums(rows, {m: weights[m] for m in active}, widths)
        for m in sorted(active):
            loss, gradient, hessian = sums[m]
            setting, w = settings[m[0]], weights[m]
            penalty = np.full(w.size, float(setting.get("regParam", 1.0 / max(1, table.training_size(m[1])))) * table.training_size(m[1]))
            penalty[-1] = 0.0
            loss += 0.5 * (penalty * w * w).sum()
            rounds[m] += 1
            last_loss, last_w, last_step = best[m]
            if loss > last_loss + 1e-12 * abs(last_loss):  # too far: half of the step
                best[m] = (last_loss, last_w, last_step / 2)
                weights[m] = last_w + last_step / 2
                if np.abs(last_step).max() < 1e-14:
                    weights[m] = last_w
                    active.discard(m)
                continue
            gradient, hessian = gradient + penalty * w, hessian + np.diag(penalty)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            best[m] = (loss, w, step)
            if -gradient @ step < float(setting.get("tol", 1e-6)) ** 2 * max(1.0, loss) or rounds[m] >= int(setting.get("maxIter", 1000)):
                active.discard(m)
            else:
                weights[m] = w + step
    return weights


def _logistic_predictions(table: FoldTable, settings: Sequence[Mapping[str, object]]) -> DataFrame:
    fitted = fit_logistic_folds(table, settings)

    def predicted(s: int) -> str:
        cases = []
        for k, p in table.preparations.items():
            w = fitted[(s, k)]
            margin = " + ".join([double_sql(w[-1]), *[f"{double_sql(a)} * ({e})" for a, e in zip(w, p.expressions)]])
            cases.append(f"WHEN {k} THEN CAST({margin} > 0 AS int)")
        return f"struct({s} AS setting, CASE fold {' '.join(cases)} END AS prediction)"

    each = f"inline(array({', '.join(predicted(s) for s in range(len(settings)))}))"
    return table.rows.selectExpr(quoted(table.spec.id), "fold", "CAST(label AS int) AS label", each)


def fold_predictions(table: FoldTable, kind: str, settings: Sequence[Mapping[str, object]], parallelism: int = 4) -> DataFrame:
    """id, fold, label, setting (its place), prediction: each row predicted by the models of its fold, which have not seen it.

    Logistic regressions of all folds and settings are fitted in shared passes; other learners fit fold by fold, side by
    side, on the one layout.
    """
    use_checkpoints(table.rows.sparkSession)
    if kind == "logistic_regression" and all(set(s) <= SHARED_SETTINGS for s in settings):
        return staged(_logistic_predictions(table, settings), "predictions")

    def one_fold(fold: int) -> list[DataFrame]:
        preparation = table.preparations[fold]
        train = table.rows.where(F.col("fold") != fold)
        prepare = Pipeline(stages=preparation.stages()).fit(train)
        vectors = prepare.transform(train).select("label", "features")
        vectors = staged(vectors, "vectors") if len(settings) > 1 else vectors
        held_out = prepare.transform(table.rows.where(F.col("fold") == fold))
        return [
            make_classifier(kind, table.training_size(fold), **setting).fit(vectors).transform(held_out).select(
                F.col(quoted(table.spec.id)), "fold", F.col("label").cast("int"), F.lit(i).alias("setting"), F.col("prediction").cast("int")
            )
            for i, setting in enumerate(settings)
        ]

    with ThreadPool(min(parallelism, len(table.preparations))) as pool:
        run = inheritable_thread_target(table.rows.sparkSession)(one_fold)
        parts = list(itertools.chain.from_iterable(pool.map(run, list(table.preparations))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return staged(whole, "predictions")


def fold_accuracies(predictions: DataFrame) -> DataFrame:
    """setting, fold, n, accuracy."""
    rates = with_rates(outcome_counts(predictions, ["setting", "fold"]))
    return rates.select("setting", "fold", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "accuracy")


def setting_names(settings: Sequence[Mapping[str, object]]) -> list[str]:
    return [", ".join(f"{k}={v}" for k, v in sorted(s.items())) for s in settings]


def cross_validate(
    df: DataFrame, spec: CustomerTable, kind: str = "logistic_regression", folds: int = 5, scaled: bool = True, parallelism: int = 4, **settings
) -> DataFrame:
    """Held-out rows and accuracy of each stratified fold."""
    return fold_accuracies(fold_predictions(fold_table(df, spec, folds, scaled), kind, [settings], parallelism)).drop("setting")


def search(
    df: DataFrame, spec: CustomerTable, kind: str, grid: Iterable[Mapping[str, object]], folds: int = 3, parallelism: int = 4
) -> DataFrame:
    """Mean and lowest fold accuracy per parameter setting, best first."""
    settings = list(grid)
    if not settings:
        raise ValueError("the grid is empty")
    table = fold_accuracies(fold_predictions(fold_table(df, spec, folds), kind, settings, parallelism))
    return _means(table, settings).drop("place").orderBy(F.desc("mean_accuracy"), "setting")


def _means(table: DataFrame, settings: Sequence[Mapping[str, object]]) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in setting_names(settings)]), F.col("setting") + 1)
    return table.groupBy(F.col("setting").alias("place"), name.alias("setting")).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("lowest_accuracy")
    )


@dataclass(frozen=True)
class Halving:
    """What a search by halving tried: ``rungs`` (rung, rows, setting, mean_accuracy, lowest_accuracy, kept), the settings'
    fold predictions of each rung, and the winner."""

    rungs: DataFrame
    predictions: Mapping[int, DataFrame]
    winner: Mapping[str, object]


def halving_search(
    df: DataFrame,
    spec: CustomerTable,
    kind: str,
    grid: Iterable[Mapping[str, object]],
    folds: int = 3,
    factor: int = 3,
    rungs: int = 3,
    seed: int = 42,
    parallelism: int = 4,
) -> Halving:
    """Successive halving: all settings are validated on a small sample, the best 1/``factor`` of them (ties: in the
    order of the grid) on a sample ``factor`` times as large, and so on; the last rung takes all rows. Samples are nested:
    a row is in all from the first that its id's hash admits. Folds are those of the whole table, at every rung.
    """
    settings = list(grid)
    if not settings:
        raise ValueError("the grid is empty")
    whole = fold_table(df, spec, folds)
    levels = fit_levels(df, spec.categorical)
    open_settings, told, predictions = list(range(len(settings))), [], {}
    for rung in range(rungs):
        share = factor ** (rung - rungs + 1)
        rows = whole.rows if rung == rungs - 1 else whole.rows.where(sample_key(F.col(quoted(spec.id)), seed) < share * 2.0**52)
        table = whole if rung == rungs - 1 else with_preparations(rows, spec, levels)
        tried = [settings[i] for i in open_settings]
        predictions[rung] = fold_predictions(table, kind, tried, parallelism)
        means = {r["place"]: r for r in _means(fold_accuracies(predictions[rung]), tried).collect()}  # a row for each setting
        ranked = sorted(means, key=lambda i: (-means[i]["mean_accuracy"], i))
        kept = ranked[: 1 if rung == rungs - 1 else max(1, -(-len(ranked) // factor))]
        n = sum(table.sizes.values())
        for i in range(len(tried)):
            told.append((rung, n, means[i]["setting"], means[i]["mean_accuracy"], means[i]["lowest_accuracy"], i in kept))
        open_settings = [open_settings[i] for i in sorted(kept)]
    schema = "rung int, rows long, setting string, mean_accuracy double, lowest_accuracy double, kept boolean"
    return Halving(df.sparkSession.createDataFrame(told, schema), predictions, settings[open_settings[0]])
