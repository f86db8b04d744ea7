"""Composite jobs: events to matrices, scores and evaluations, forward runs, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.jobs.experiment import BASELINES, PLAN, experiment_models, experiment_results, run_experiment
from tidemark.jobs.ledger import Ledger
from tidemark.operators import analysis, audit, evaluate, rank, selection
from tidemark.operators import features as X
from tidemark.operators import impute as I
from tidemark.operators import score as B
from tidemark.operators.entities import cohort_from_events, make_labels
from tidemark.operators.matrix import KEYS, align_columns, build_matrix, downcast, feature_groups, matrix_index, mix_groups
from tidemark.operators.models import Fit, score_models
from tidemark.operators.splits import TemporalConfig, chop_time, matrix_plans, training_times
from tidemark.sources.tables import write_results

MATRIX_INTERVALS = ["7 days", "all"]
MATRIX_AGGS = [X.Agg("n", "*", ("count",), rules={"all": "zero"}), X.Agg("value", "value", ("sum",), rules={"all": "zero"})]


@dataclass(frozen=True)
class FeatureSpec:
    """Aggregates over windows of the events that meet a condition (SQL)."""

    prefix: str
    group: str
    intervals: tuple[str, ...]
    aggs: tuple[X.Agg, ...]
    condition: str | None = None

    def of(self, events: DataFrame, spec: MatrixSpec, cohort: DataFrame, dates: Sequence[date]) -> DataFrame:
        rows = events if self.condition is None else events.filter(self.condition)
        raw = X.spacetime_aggregate(rows, spec.entity, spec.when, dates, self.intervals, self.aggs, self.prefix, self.group, cohort)
        return I.impute(cohort, raw, I.resolve_rules(self.prefix, self.group, self.intervals, self.aggs))


@dataclass(frozen=True)
class MatrixSpec:
    """What a user's matrices are made of: whose events and when, who is in the cohort (by a condition, in SQL, on an event
    before the date, or ``within`` a time before it), the outcome (SQL) and how it makes a label, and features
    with their imputation rules."""

    entity: str = "user_id"
    when: str = "ts"
    outcome: str = "event_type = 'purchase'"
    how: str = "any"
    condition: str | None = None
    within: str | None = None
    features: tuple[FeatureSpec, ...] = (FeatureSpec("ev", "user", tuple(MATRIX_INTERVALS), tuple(MATRIX_AGGS)),)

    def cohort(self, events: DataFrame, dates: Sequence[date]) -> DataFrame:
        return cohort_from_events(events, self.entity, self.when, dates, None if self.condition is None else F.expr(self.condition), self.within)

    def labels(self, events: DataFrame, dates: Sequence[date], timespans: Sequence[str]) -> DataFrame:
        return make_labels(events, self.entity, self.when, dates, timespans, F.expr(self.outcome), how=self.how)

    def matrix_features(self, events: DataFrame, cohort: DataFrame, dates: Sequence[date]) -> DataFrame:
        """Imputed features of the cohort's rows."""
        parts = [f.of(events, self, cohort, dates) for f in self.features]
        return reduce(lambda a, b: a.join(b, list(KEYS)), parts)


#: Users by their events, labelled by purchases.
USERS = MatrixSpec()


def matrix_features(events: DataFrame, cohort: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Imputed features of users in a cohort."""
    return USERS.matrix_features(events, cohort, dates)


def training_matrix(events: DataFrame, dates: Sequence[date], timespan: str = "7 days", spec: MatrixSpec = USERS) -> DataFrame:
    """Splits given: cohort, labels, features, imputation and matrix for all dates at once."""
    cohort, labels = spec.cohort(events, dates), spec.labels(events, dates, [timespan])
    return build_matrix(matrix_index(cohort, labels, dates, "train"), [spec.matrix_features(events, cohort, dates)], labels)


def forward_matrix(events: DataFrame, day: date, spec: MatrixSpec = USERS, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows to score on a day that has no labels yet, with the features ``columns`` of a model, where given, in
    their order; one that is not there is an error."""
    cohort = spec.cohort(events, [day])
    out = build_matrix(cohort.select(*KEYS), [spec.matrix_features(events, cohort, [day])], None)
    if columns is None:
        return out
    return align_columns(out.select(*[c for c in out.columns if c in (*KEYS, "label", *columns)]), columns)


def predict_with_model(events: DataFrame, day: date, path: str, model_id: int, spec: MatrixSpec = USERS) -> DataFrame:
    """A new day's rows scored by a model that an experiment has stored in ``path``, and ranked."""
    spark = events.sparkSession
    found = Ledger(spark, path).models().filter(F.col("model_id") == model_id).collect()
    if not found or found[0].model_type in BASELINES:
        raise ValueError(f"no learned model {model_id} in {path}")
    model = found[0]
    rows = forward_matrix(events, day, spec, model.feature_list).withColumn("split", F.lit(model.split))
    tables = spark.read.parquet(f"{path}/tables").filter(F.col("model_id") == model_id)
    pred = score_models(rows, tables, [Fit(model_id, model.split, model.model_type, {}, tuple(model.feature_list))])
    pred = pred.withColumns({"score": F.round("score", 6), "label": F.lit(None).cast("int")})
    return rank.rank_predictions(pred, "random", seed=1).drop("label")


def run_scoring(matrix: DataFrame, columns: Sequence[str], weights: Sequence[float], defs: DataFrame) -> DataFrame:
    """Linear scores, ranks and evaluations of a matrix as model 1."""
    pred = B.score_linear(matrix, columns, weights).select(F.lit(1).cast("long").alias("model_id"), *KEYS, F.round("score", 8).alias("score"), "label")
    return evaluate.evaluate(pred, defs)


def run_audit(pred: DataFrame, attributes: DataFrame, names: Sequence[str], thresholds: DataFrame, method: str = "majority") -> DataFrame:
    """Ranks, counts, rates, disparities and parity by protected attribute."""
    ct = audit.group_crosstab(rank.rank_predictions(pred, "worst"), attributes, names, thresholds)
    return audit.parity(audit.disparity(audit.group_rates(ct), method))


def predict_forward(events: DataFrame, day: date, train: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """A new day's rows scored by features scaled as in training, and ranked."""
    stats = B.fit_min_max(train, columns)
    scaled = B.apply_min_max(forward_matrix(events, day), stats, columns)
    total = sum(weights)
    score = sum((F.col(f"`{c}`") * (w / total) for c, w in zip(columns[1:], weights[1:], strict=True)), F.col(f"`{columns[0]}`") * (weights[0] / total))
    pred = scaled.select(F.lit(1).cast("long").alias("model_id"), *KEYS, F.round(score, 6).alias("score"), F.lit(None).cast("int").alias("label"))
    return rank.rank_predictions(pred, "random", seed=1).drop("label")


def retrain_and_predict(events: DataFrame, cfg: TemporalConfig, day: date, columns: Sequence[str], spec: MatrixSpec = USERS, **params) -> DataFrame:
    """A logistic model on the rows that a split at ``day`` trains on by the config (first of each list), then scores
    and ranks for the day."""
    timespan = cfg.train_timespans[0]
    dates = [t.date() for t in training_times(cfg, datetime(day.year, day.month, day.day), timespan, cfg.train_frequencies[0], cfg.max_histories[0])]
    model = B.train_scaled_lr(training_matrix(events, dates, timespan, spec), columns, **params)
    pred = B.score(model, forward_matrix(events, day, spec)).select(F.lit(1).cast("long").alias("model_id"), *KEYS, "score", F.lit(None).cast("int").alias("label"))
    return rank.rank_predictions(pred, "random", seed=1).drop("label")


def run_matrices(events: DataFrame, cfg: TemporalConfig, path: str | None = None, spec: MatrixSpec = USERS) -> DataFrame:
    """Train and test rows of every split of the config: ``split, split_time, matrix_type, timespan, frequency``,
    the keys, features and ``label``.

    Cohort, labels and features are made once for all dates; the plan of dates then deals the rows to their matrices.
    Training rows have a label; test rows may lack one. A set of features is a set of columns (see ``feature_sets``).
    With a ``path`` they are stored by split and type, those of other splits staying as they are.
    """
    plans = matrix_plans(cfg)
    dates = sorted({d.date() for p in plans for d in p["dates"]})
    cohort, labels = spec.cohort(events, dates), spec.labels(events, dates, sorted({p["timespan"] for p in plans}))
    plan = F.broadcast(chop_time(events.sparkSession, cfg))  # a config's dates
    rows = spec.matrix_features(events, cohort, dates).join(plan, "as_of_date")
    labels = labels.select(*KEYS, F.col("label_timespan").alias("timespan"), "label")
    rows = rows.join(labels, [*KEYS, "timespan"], "left").filter("matrix_type = 'test' or label is not null")
    out = downcast(rows.select(*PLAN, *KEYS, *[c for c in rows.columns if c not in (*PLAN, *KEYS, "label")], "label"), (*PLAN, *KEYS, "label"))
    if path is None:
        return out
    write_results(out, path, ("split", "matrix_type"))
    return events.sparkSession.read.schema(out.schema).parquet(path)


def feature_sets(matrices: DataFrame, definition: dict[str, Sequence[str]], strategies: Sequence[str]) -> dict[str, list[str]]:
    """Columns of each set of feature groups, by the groups' names."""
    groups = feature_groups({"features": [c for c in matrices.columns if c not in (*PLAN, *KEYS, "label")]}, definition)
    return {", ".join(names): sorted({c for n in names for c in groups[n].get("features", [])}) for names in mix_groups(groups, strategies)}


def matrix_catalogue(matrices: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """A row for each matrix, by split, type and set of features: its id, columns, rows, labelled rows and label rate."""
    counts = matrices.groupBy(*PLAN).agg(F.count("*").alias("n_rows"), F.count("label").alias("n_labelled"), F.avg("label").alias("label_rate"))
    table = matrices.sparkSession.createDataFrame([(name, cols) for name, cols in sets.items()], "feature_set string, columns array<string>")
    both = counts.crossJoin(F.broadcast(table))  # a config's sets
    return both.withColumn("matrix_uuid", F.md5(F.to_json(F.struct(*PLAN, "columns"))))


def run_selection(dist: DataFrame, groups: DataFrame, filters: Sequence[dict], times: Sequence, grid: Sequence, metric: str, parameter: str) -> DataFrame:
    """Complete groups past the thresholds, their regrets by rule, and the mean regret."""
    good = selection.threshold_groups(dist, filters, times).join(groups, "model_group_id", "left_semi")
    left = dist.join(F.broadcast(good), "model_group_id", "left_semi")  # groups are few
    return selection.average_regret(selection.rule_regrets(left, grid, metric, parameter))


def add_predictions(models: DataFrame, matrix: DataFrame, known: DataFrame) -> DataFrame:
    """Scores of models on dates that lack them; ``models`` has ``model_id, column`` to score by."""
    dates = matrix.select("as_of_date").distinct()
    todo = rank.missing_predictions(models, known, dates)
    names = sorted({r.column for r in models.select("column").distinct().collect()})  # a few columns
    tall = matrix.unpivot(list(KEYS), [f"`{c}`" for c in names], "column", "score")
    pred = tall.join(F.broadcast(models), "column").join(todo, ["model_id", "as_of_date"], "left_semi")
    return rank.rank_predictions(pred.select("model_id", *KEYS, F.col("score").cast("double").alias("score"), F.lit(None).cast("int").alias("label")), "random")


__all__ = ["add_predictions", "analysis", "forward_matrix", "predict_forward", "predict_with_model", "experiment_models", "experiment_results", "feature_sets", "matrix_catalogue", "retrain_and_predict", "run_audit", "run_experiment", "run_matrices", "run_scoring", "run_selection", "training_matrix"]
