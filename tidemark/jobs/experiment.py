"""The grid of models over splits: fitted, scored, ranked and evaluated; with a path, only what is not done yet."""

from __future__ import annotations

import json
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.jobs.ledger import Ledger, content_hash, stored
from tidemark.operators import audit, evaluate, importance, rank, selection
from tidemark.operators.matrix import KEYS
from tidemark.operators.models import TABLE, Fit, fit_models, importances, score_models, training_faults
from tidemark.operators.splits import TemporalConfig, matrix_plans
from tidemark.sources.scratch import cut
from tidemark.sources.tables import upsert, write_results

#: What a matrix of a plan is known by.
PLAN = ("split", "split_time", "matrix_type", "timespan", "frequency")
#: Scorers without a fit.
BASELINES = ("linear", "prior")
EVALUATION = ["model_id", "metric", "parameter"]


def experiment_models(cfg: TemporalConfig, sets: dict[str, list[str]], scorers: Sequence[tuple[str, dict]], data: str = "") -> list[dict]:
    """A model for each split, set of features and scorer, numbered in this order from 1.

    ``model_hash`` is of what a model is made of: its split's dates, its columns, type and parameters, and ``data``,
    which names where the matrices come from.
    """
    splits, made_of = {}, {}
    for p in matrix_plans(cfg):
        splits[p["split"]] = p["split_time"].date()
        made_of.setdefault(p["split"], []).append([p[k] for k in ("split_time", "matrix_type", "timespan", "frequency", "history", "dates")])
    points = [(split, at, name, kind, params) for split, at in splits.items() for name in sets for kind, params in scorers]
    return [
        {"model_id": i, "split": s, "train_end_time": at, "feature_set": n, "model_type": k, "hyperparameters": json.dumps(p, sort_keys=True), "feature_list": sets[n], "model_config": "{}",
         "model_hash": content_hash(data, made_of[s], sorted(sets[n]), k, p)}
        for i, (s, at, n, k, p) in enumerate(points, 1)
    ]


def score_baselines(matrices: DataFrame, models: Sequence[dict], sets: dict[str, list[str]], kind: str = "test") -> DataFrame:
    """Predictions of all ``prior`` models (label rate of training) and ``linear`` ones (mean of the features, scaled by their
    range in training and clipped) on the test (or ``train``) rows, in one pass over all splits."""
    features = sorted({c for cols in sets.values() for c in cols})
    stats = matrices.filter("matrix_type = 'train'").groupBy("split").agg(F.avg("label").alias("_rate"), *[f(F.col(f"`{c}`")).cast("double").alias(f"_{n}{i}") for i, c in enumerate(features) for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        i = features.index(c)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"`{c}`").cast("double") - low) / F.when(high == low, 1.0).otherwise(high - low)))

    def value(m: dict) -> Column:
        cols = sets[m["feature_set"]]
        return F.col("_rate") if m["model_type"] == "prior" else reduce(operator.add, map(scaled, cols)) / len(cols)

    own = {}
    for m in (m for m in models if m["model_type"] in BASELINES):
        own.setdefault(m["split"], []).append(F.struct(F.lit(m["model_id"]).cast("long").alias("model_id"), F.round(value(m), 6).alias("score")))
    lists = F.coalesce(*[F.when(F.col("split") == split, F.array(*scores)) for split, scores in own.items()])
    rows = matrices.filter(F.col("matrix_type") == kind).join(F.broadcast(stats), "split")  # a row per split
    return rows.withColumn("_m", F.explode(lists)).select("_m.model_id", *KEYS, "_m.score", "label")


def _fits(models: Sequence[dict], sets: dict[str, list[str]]) -> list[Fit]:
    return [Fit(m["model_id"], m["split"], m["model_type"], json.loads(m["hyperparameters"]), tuple(sets[m["feature_set"]])) for m in models]


def predict(matrices: DataFrame, models: Sequence[dict], sets: dict[str, list[str]], tables: DataFrame | None, kind: str = "test") -> DataFrame:
    """Scores of the test (or ``train``) rows: baselines in one pass, learned models (from their tables) in another."""
    spark, parts = matrices.sparkSession, []
    if any(m["model_type"] in BASELINES for m in models):
        parts.append(score_baselines(matrices, models, sets, kind))
    if tables is not None and (learned := [m for m in models if m["model_type"] not in BASELINES]):
        scored = score_models(matrices.filter(F.col("matrix_type") == kind), tables, _fits(learned, sets))
        parts.append(scored.withColumn("score", F.round("score", 6)))
    kinds = {f.name: f.dataType.simpleString() for f in matrices.schema}
    none = spark.createDataFrame([], f"model_id long, {KEYS[0]} {kinds[KEYS[0]]}, {KEYS[1]} {kinds[KEYS[1]]}, score double, label {kinds['label']}")
    return reduce(DataFrame.unionByName, parts, none) if parts else none


def _train(matrices: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Training rows with the columns that some model needs, written once for all fits."""
    columns = sorted({c for f in fits for c in f.columns})
    return cut(matrices.filter("matrix_type = 'train'").select("split", "label", *[F.col(f"`{c}`") for c in columns]), "train")


def run_experiment(matrices: DataFrame, cfg: TemporalConfig, sets: dict[str, list[str]], scorers: Sequence[tuple[str, dict]], defs: DataFrame, path: str | None = None, tie_rule: str = "worst", seed: int = 0, data: str = "") -> dict[str, DataFrame]:
    """Trains and scores a model for each split, set of features and scorer; ranks and evaluates its test rows.

    Gives ``models`` (with their group), ``predictions`` with ranks and tie rule, ``evaluations``, and ``skipped``: models of
    splits without training rows, and learned ones of splits with labels of one class, which have no predictions. Null
    features are an error in training; a test row with one has a null score by the models that use it.

    With a ``path`` all is stored by model, and a ledger says what is there: a model that has been seen keeps its
    id, group and rows, and other experiments in the path keep theirs. Only what is missing is done: models
    without their rows are fitted (unless their tables are stored) and scored, another tie rule ranks the stored
    scores anew, and metrics without a value are computed.
    """
    spark = matrices.sparkSession
    plan = experiment_models(cfg, sets, scorers, data)
    manner = tie_rule if tie_rule != "random" else f"random:{seed}"
    ranked = lambda rows: rank.rank_predictions(rows, tie_rule, seed).withColumn("tie_rule", F.lit(manner))
    if path is None:
        rows = spark.createDataFrame(plan, "model_id long, split int, train_end_time date, feature_set string, model_type string, hyperparameters string, feature_list array<string>, model_config string, model_hash string")
        fits = _fits(plan, sets)
        train = _train(matrices, fits)
        faults = training_faults(train, fits)
        good = [m for m in plan if m["model_id"] not in faults]
        learned = [f for f in fits if f.kind not in BASELINES and f.model_id not in faults]
        pred = cut(predict(matrices, good, sets, fit_models(train, learned) if learned else None), "predictions")
        return {"models": selection.assign_model_groups(rows), "predictions": ranked(pred), "evaluations": evaluate.evaluate(pred, defs), "skipped": spark.createDataFrame(list(faults.items()), "model_id long, reason string")}

    ledger = Ledger(spark, path)
    models = ledger.register(plan)
    ids = {r.model_hash: r.model_id for r in models.select("model_hash", "model_id").collect()}
    for m in plan:
        m["model_id"] = ids[m["model_hash"]]
    kinds = {f.name: f.dataType.simpleString() for f in matrices.schema}
    schemas = {
        "predictions": f"{KEYS[0]} {kinds[KEYS[0]]}, {KEYS[1]} {kinds[KEYS[1]]}, score double, label {kinds['label']}, rank_abs_no_ties long, rank_abs_with_ties long, rank_pct_no_ties double, rank_pct_with_ties double, tie_rule string, model_id long",
        "evaluations": "metric string, parameter string, best_value double, worst_value double, stochastic_value double, standard_deviation double, num_sort_trials int, num_labeled_examples long, num_labeled_above_threshold long, num_positive_labels long, model_id long",
        "tables": f"{TABLE.removeprefix('model_id long, ')}, model_id long",
        "skipped": "reason string, model_id long",
    }
    table = lambda name: stored(spark, f"{path}/{name}", schemas[name])

    # Scores: what is not there in any manner.
    score_ids = ledger.missing(models, "scores", "", table("predictions"))
    if score_ids:
        todo = [m for m in plan if m["model_id"] in score_ids]
        unfitted = set(ledger.missing(models, "fit", "", table("tables")))
        fits = _fits(todo, sets)
        train = _train(matrices, fits)
        faults = training_faults(train, fits)
        learned = [f for f in fits if f.kind not in BASELINES and f.model_id not in faults]
        if fresh := [f for f in learned if f.model_id in unfitted]:
            write_results(fit_models(train, fresh), f"{path}/tables")
            ledger.commit([f.model_id for f in fresh], "fit", "", table("tables"))
        if faults:
            write_results(spark.createDataFrame(list(faults.items()), "model_id long, reason string"), f"{path}/skipped")
        pred = cut(predict(matrices, [m for m in todo if m["model_id"] not in faults], sets, table("tables").filter(F.col("model_id").isin([f.model_id for f in learned])) if learned else None), "predictions")
        write_results(ranked(pred), f"{path}/predictions")
        ledger.commit(score_ids, "scores", "", table("predictions"))
        ledger.commit(score_ids, "ranks", manner, table("predictions"))

    # Ranks: stored scores in another order of ties.
    if rank_ids := ledger.missing(models, "ranks", manner, table("predictions")):
        rows = cut(table("predictions").filter(F.col("model_id").isin(rank_ids)).select("model_id", *KEYS, "score", "label"), "scores")
        write_results(ranked(rows), f"{path}/predictions")
        ledger.commit(rank_ids, "ranks", manner, table("predictions"))

    # Evaluations: metrics that a model has no row of, or all of a model that was scored just now.
    mine = [m["model_id"] for m in plan]
    asked = content_hash(sorted(map(str, defs.collect())))  # a config's rows
    if late := sorted({*score_ids, *ledger.missing(models, "evaluations", asked, table("evaluations"))}):
        kept = table("evaluations").filter(F.col("model_id").isin([i for i in late if i not in score_ids]))
        wanted = models.filter(F.col("model_id").isin(late)).select("model_id").crossJoin(F.broadcast(defs.select("metric", "parameter").distinct()))
        lacking = wanted.join(kept, EVALUATION, "left_anti").groupBy("metric", "parameter").agg(F.collect_set("model_id").alias("ids")).collect()  # a config's metrics and models
        if lacking:
            some = defs.join(F.broadcast(spark.createDataFrame([(r.metric, r.parameter) for r in lacking], "metric string, parameter string")), ["metric", "parameter"], "left_semi")
            ids = sorted({i for r in lacking for i in r.ids})
            found = evaluate.evaluate(table("predictions").filter(F.col("model_id").isin(ids)), some)
            found = found.select(*[F.col(f.name).cast(f.dataType) for f in table("evaluations").schema])
            old = kept.filter(F.col("model_id").isin(ids))
            write_results(cut(upsert(old, found, EVALUATION), "evaluated"), f"{path}/evaluations")
        ledger.commit(late, "evaluations", asked, table("evaluations"))
    chosen = F.col("model_id").isin(mine)
    return {"models": models, **{name: table(name).filter(chosen) for name in ("predictions", "evaluations", "skipped")}}


def experiment_results(matrices: DataFrame, path: str, defs: DataFrame, subsets: dict[str, DataFrame] | None = None, attributes: DataFrame | None = None, names: Sequence[str] = (), thresholds: DataFrame | None = None, top: int = 5) -> dict[str, DataFrame]:
    """What else is asked of the models that are stored in a path and whose splits the matrices have.

    ``evaluations`` by ``matrix_type`` (training rows are scored here, test scores are stored) and ``subset`` (entity
    dates, ``""`` for all): all of them go through one table of score groups. ``importances`` of the learned models, ranked,
    ``individual`` ones of the test rows for the ``top`` features, and with ``attributes`` an ``audit`` of the test rows.
    """
    spark, ledger = matrices.sparkSession, Ledger(matrices.sparkSession, path)
    splits = [r.split for r in matrices.select("split").distinct().collect()]
    skipped = stored(spark, f"{path}/skipped", "reason string, model_id long").select("model_id")
    plan = [r.asDict() for r in ledger.models().filter(F.col("split").isin(splits)).join(skipped, "model_id", "left_anti").collect()]  # a config's models
    sets = {f"{m['model_id']}": m["feature_list"] for m in plan}
    for m in plan:
        m["feature_set"] = f"{m['model_id']}"
    ids = [m["model_id"] for m in plan]
    tables = stored(spark, f"{path}/tables", f"{TABLE.removeprefix('model_id long, ')}, model_id long").filter(F.col("model_id").isin(ids))
    base = ["model_id", *KEYS, "score", "label"]
    test = spark.read.parquet(f"{path}/predictions").filter(F.col("model_id").isin(ids)).select(*base)
    train = cut(predict(matrices, plan, sets, tables, "train").select(*base), "train-scores")

    # A model, type of matrix and subset is a model of its own to the metrics.
    kinds = [(t, s) for s in ("", *sorted(subsets or {})) for t in ("train", "test")]
    rows = None
    for code, (kind, name) in enumerate(kinds):
        one = train if kind == "train" else test
        if name:
            one = one.join(subsets[name].select(*KEYS).distinct(), list(KEYS), "left_semi")
        one = one.withColumn("model_id", (F.col("model_id") * len(kinds) + code).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    found = evaluate.evaluate(rows, defs)
    place = F.pmod(F.col("model_id"), F.lit(len(kinds))).cast("int")
    named = [F.get(F.array(*[F.lit(k[i]) for k in kinds]), place).alias(n) for i, n in enumerate(("matrix_type", "subset"))]
    out = {"evaluations": found.select(F.floor(F.col("model_id") / len(kinds)).cast("long").alias("model_id"), *named, *[c for c in found.columns if c != "model_id"])}
    weights = importances(tables)
    out["importances"] = importance.rank_importances(weights)
    if any(m["model_type"] not in BASELINES for m in plan):
        own = F.broadcast(spark.createDataFrame([(m["model_id"], m["split"]) for m in plan], "model_id long, split int"))
        out["individual"] = importance.individual_importance(matrices.filter("matrix_type = 'test'"), weights.join(own, "model_id"), top, ["split"])
    if attributes is not None:
        ct = audit.group_crosstab(rank.rank_predictions(test, "worst"), attributes, names, thresholds)
        out["audit"] = audit.parity(audit.disparity(audit.group_rates(ct), "majority"))
    return out
