"""Thresholded metrics, tie sensitivity, AUC and average precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.order import running_totals
from tidemark.operators.rank import tie_key
from tidemark.sources.scratch import cut

#: Orders tried at random, and the relative closeness of extremes within which none is tried.
TRIALS, CLOSE = 30, 0.01
#: Leading hexadecimal digits of tie keys by which tied rows are counted.
DIGITS = 3


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _fbeta(beta: float) -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _ratio((1 + beta**2) * tp, (1 + beta**2) * tp + beta**2 * fn + fp)


#: Metric name to (column over tp, fp, tn, fn; whether greater is better).
METRICS: dict[str, tuple[Callable[..., Column], bool]] = {
    "precision@": (lambda: _ratio(F.col("tp"), F.col("tp") + F.col("fp")), True),
    "recall@": (lambda: _ratio(F.col("tp"), F.col("tp") + F.col("fn")), True),
    "fbeta@": (lambda beta=1.0: _fbeta(beta), True),
    "f1": (lambda: _fbeta(1.0), True),
    "accuracy": (lambda: _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), True),
    "true positives@": (lambda: F.col("tp").cast("double"), True),
    "true negatives@": (lambda: F.col("tn").cast("double"), True),
    "false positives@": (lambda: F.col("fp").cast("double"), False),
    "false negatives@": (lambda: F.col("fn").cast("double"), False),
    "fpr@": (lambda: F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), False),
}


def register_metric(name: str, column: Callable[..., Column], greater_is_better: bool) -> None:
    """Adds a metric made of the confusion counts."""
    METRICS[name] = (column, greater_is_better)


def metric_definitions(spark: SparkSession, groups: Sequence[dict]) -> DataFrame:
    """Config groups (``metrics, thresholds: {percentiles, top_n}, parameters``) to rows ``metric,
    unit, value, beta, parameter``; the parameter text is e.g. ``100_abs``, ``5.0_pct`` or
    ``0.75_beta/10_pct``, and empty without a threshold."""
    rows = []
    for g in groups:
        at = [("pct", float(p), f"{p}_pct") for p in g.get("thresholds", {}).get("percentiles", [])]
        at += [("abs", float(n), f"{n}_abs") for n in g.get("thresholds", {}).get("top_n", [])]
        for metric in g["metrics"]:
            for params in g.get("parameters", [{}]):
                text = "/".join(f"{v}_{k}" for k, v in sorted(params.items()))
                for unit, value, name in at or [("all", 100.0, "")]:
                    rows.append((metric, unit, value, float(params.get("beta", 1.0)), "/".join(x for x in (text, name) if x)))
    return spark.createDataFrame(rows, "metric string, unit string, value double, beta double, parameter string")


def _thresholds(defs: DataFrame) -> DataFrame:
    return defs.select("unit", "value").distinct()


def cutoffs(sizes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``model_id, unit, value, n, cutoff``: how many of the first rows are predicted positive.

    A share is a double before it is multiplied: 29 % of 100 are 28.999..., so 28 rows.
    """
    raw = F.when(F.col("unit") == "abs", F.col("value")).otherwise(F.floor(F.col("n") * (F.col("value") / 100)))
    # A handful of thresholds from a config.
    return sizes.crossJoin(F.broadcast(thresholds)).withColumn("cutoff", F.least(raw.cast("long"), F.col("n")))


def binarize(ranked: DataFrame, thresholds: DataFrame, rank_col: str = "rank_abs_no_ties") -> DataFrame:
    """Each row once per threshold with its predicted class; for small tables, see ``confusion``."""
    sizes = ranked.groupBy("model_id").agg(F.count("*").alias("n"))
    return ranked.join(cutoffs(sizes, thresholds), "model_id").withColumn("predicted", (F.col(rank_col) <= F.col("cutoff")).cast("int"))


def score_groups(pred: DataFrame) -> DataFrame:
    """``model_id, score, m, l, p`` (rows, labelled rows, positives of a score) and ``m0, l0, p0``, the same
    of all higher scores of the model. A null score comes last. Made once, it serves all metrics."""
    y = F.coalesce(F.sum("label"), F.lit(0)).cast("long")
    groups = pred.groupBy("model_id", "score").agg(F.count("*").alias("m"), F.count("label").alias("l"), y.alias("p"))
    upto = running_totals(groups, ["model_id"], [F.col("score").desc_nulls_last()], {"m0": F.col("m"), "l0": F.col("l"), "p0": F.col("p")})
    return cut(upto.withColumns({f"{c}0": F.col(f"{c}0") - F.col(c) for c in ("m", "l", "p")}), "scores")


def _around(groups: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each model and threshold with its totals and, beside them, the score at which it cuts; ``k`` rows of that score
    are above the cutoff. A cutoff of 0 has no such score."""
    totals = groups.groupBy("model_id").agg(F.sum("m").alias("n"), F.sum("l").alias("n_labeled"), F.sum("p").alias("n_positive"))
    at = cutoffs(totals, thresholds)
    inside = at.select(F.col("model_id").alias("_m"), F.col("unit").alias("_u"), F.col("value").alias("_v"), "cutoff")
    # Models by a config's thresholds.
    found = groups.join(F.broadcast(inside), [F.col("model_id") == F.col("_m"), F.col("m0") < F.col("cutoff"), F.col("cutoff") <= F.col("m0") + F.col("m")])
    found = found.select("_m", "_u", "_v", "score", "m", "l", "p", "l0", "p0", (F.col("cutoff") - F.col("m0")).alias("k"))
    return at.join(found, [F.col("model_id") == F.col("_m"), F.col("unit") == F.col("_u"), F.col("value") == F.col("_v")], "left").drop("_m", "_u", "_v")


def _with_counts(at: DataFrame, n_above: Column, tp: Column) -> DataFrame:
    at = at.withColumns({"n_above": F.coalesce(n_above, F.lit(0)).cast("long"), "tp": F.coalesce(tp, F.lit(0)).cast("long")})
    return at.withColumns({"fp": F.col("n_above") - F.col("tp"), "fn": F.col("n_positive") - F.col("tp")}).withColumn("tn", F.col("n_labeled") - F.col("n_above") - F.col("fn"))


def _extreme(around: DataFrame, rule: str) -> DataFrame:
    """Counts with the tied rows of the cut in ``worst`` order (unlabelled, negatives, positives) or in ``best`` order."""
    m, n, p, k = F.col("m"), F.col("l"), F.col("p"), F.col("k")
    labelled, positive = {"worst": (F.greatest(F.lit(0), k - (m - n)), F.greatest(F.lit(0), k - (m - p))), "best": (F.least(k, n), F.least(k, p))}[rule]
    return _with_counts(around, F.col("l0") + labelled, F.col("p0") + positive).drop("score", "m", "l", "p", "l0", "p0", "k")


def confusion(pred: DataFrame, thresholds: DataFrame, rule: str = "worst") -> DataFrame:
    """Counts per model and threshold over labelled rows; cutoffs count unlabelled rows too. Ties are in ``worst`` or
    ``best`` order (see ``tie_trials`` for random ones).

    Running counts over the distinct scores are looked up at the cutoffs; rows are neither sorted nor
    crossed with thresholds.
    """
    return _extreme(_around(score_groups(pred), thresholds), rule)


def metrics(conf: DataFrame, defs: DataFrame, value: str = "value_") -> DataFrame:
    """``metric, parameter`` and its value for each row of counts, as ``value``."""
    joined = conf.join(F.broadcast(defs.withColumnsRenamed({"unit": "_u", "value": "_v"})), (F.col("unit") == F.col("_u")) & (F.col("value") == F.col("_v")))
    column = F.lit(None).cast("double")
    for name in SCORE_METRICS:
        if name in conf.columns:
            column = F.when(F.col("metric") == name, F.col(f"`{name}`")).otherwise(column)
    for name, (make, _) in METRICS.items():
        column = F.when(F.col("metric") == name, _fbeta_by_column() if name == "fbeta@" else make()).otherwise(column)
    return joined.withColumn(value, column).drop("_u", "_v")


def _fbeta_by_column() -> Column:
    b2, tp, fp, fn = F.col("beta") * F.col("beta"), F.col("tp"), F.col("fp"), F.col("fn")
    return _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def _auc(groups: DataFrame) -> DataFrame:
    negatives = F.col("l") - F.col("p")
    totals = groups.groupBy("model_id").agg(F.sum(negatives).alias("_q"))
    below = F.col("_q") - (F.col("l0") - F.col("p0")) - negatives
    won = F.sum(F.col("p") * (below + negatives / 2))
    return groups.join(totals, "model_id").groupBy("model_id").agg(F.try_divide(won, (F.sum("p") * F.first("_q")).cast("double")).alias("roc_auc"), F.sum("l").alias("_l")).filter("_l > 0").drop("_l")


def roc_auc(pred: DataFrame) -> DataFrame:
    """``model_id, roc_auc`` by score groups; tied scores count half, and one class only gives null."""
    return _auc(score_groups(pred))


def _average_precision(groups: DataFrame) -> DataFrame:
    p, n = F.col("p"), F.col("l")
    return groups.filter("l > 0").groupBy("model_id").agg(F.try_divide(F.sum(p * (F.col("p0") + p) / (F.col("l0") + n)), F.sum("p").cast("double")).alias("average_precision"))


def average_precision(pred: DataFrame) -> DataFrame:
    """``model_id, average_precision``: precision at each distinct score, weighted by gained recall."""
    return _average_precision(score_groups(pred))


#: Metrics of the scores alone, without a threshold: their values by model from score groups. Greater is better in both.
SCORE_METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {"roc_auc": _auc, "average precision score": _average_precision}


def greater_is_better(metric: str) -> bool:
    """Of a known metric, registered ones included; others are an error."""
    if metric in SCORE_METRICS:
        return True
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return METRICS[metric][1]


def tie_trials(pred: DataFrame, thresholds: DataFrame, trials: int = TRIALS, groups: DataFrame | None = None) -> DataFrame:
    """Counts as in ``confusion`` for each of ``trials`` random tie orders, with a ``trial`` column, of the
    thresholds whose counts depend on the order of ties; those of the others are the same in each order.

    Only the tied rows around such a cutoff are looked at, and they are not sorted: they are counted by the leading
    digits of their tie key, with a map-side combine, and only those of the digits in which a cutoff falls are ordered. A tie key
    is the same in all models: an entity and date has it made once for all of them, and is counted once for those that tie the same rows.
    """
    around = _around(score_groups(pred) if groups is None else groups, thresholds)
    n_rows, n, p, k = F.col("m"), F.col("l"), F.col("p"), F.col("k")
    varies = (F.least(k, n) > F.greatest(F.lit(0), k - (n_rows - n))) | (F.least(k, p) > F.greatest(F.lit(0), k - (n_rows - p)))
    open_ = cut(around.filter(varies), "ties")
    # Models by a config's thresholds, so one window numbers them.
    tied = cut(open_.select(F.col("model_id").alias("_m"), F.col("score").alias("_s")).distinct().withColumn("_id", F.row_number().over(W.orderBy("_m", "_s"))), "tied")
    rows = pred.join(F.broadcast(tied), [F.col("model_id") == F.col("_m"), F.col("score").eqNullSafe(F.col("_s"))])
    rows = cut(rows.groupBy("entity_id", "as_of_date", "label").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), "tied-rows")
    rows = rows.repartition(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but a row is much work
    tried = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("_key", tie_key(F.col("trial").cast("string")))
    one, labelled, positive = F.lit(1).cast("long"), F.col("label").isNotNull().cast("long"), F.coalesce("label", F.lit(0)).cast("long")
    tried = tried.select("_ids", "trial", F.substring("_key", 1, DIGITS).alias("_bin"), "_key", "entity_id", "as_of_date", one.alias("_n"), labelled.alias("_l"), positive.alias("_p"))
    by = ["_m", "_s", "trial"]
    sums = {c: F.sum(c) for c in ("_n", "_l", "_p")}
    by_model = lambda df: df.withColumn("_id", F.explode("_ids")).drop("_ids").join(F.broadcast(tied), "_id").drop("_id")
    bins = by_model(tried.groupBy("_ids", "trial", "_bin").agg(*[f.alias(c) for c, f in sums.items()])).groupBy(*by, "_bin").agg(*[f.alias(c) for c, f in sums.items()])
    w = W.partitionBy(*by).orderBy("_bin")  # 16^DIGITS rows at most
    before = bins.withColumns({f"{c}0": f.over(w) - F.col(c) for c, f in sums.items()})
    # Models by a config's thresholds; each has one row per trial.
    found = cut(before.join(F.broadcast(open_), [F.col("_m") == F.col("model_id"), F.col("_s").eqNullSafe(F.col("score")), F.col("_n0") < F.col("k"), F.col("k") <= F.col("_n0") + F.col("_n")]), "trials")
    there = found.select(*[F.col(c).alias(f"{c}_") for c in (*by, "_bin")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*by, "_bin")]
    near = there.select(F.col("trial_").alias("trial"), F.col("_bin_").alias("_bin")).distinct()
    within = by_model(tried.join(F.broadcast(near), ["trial", "_bin"], "left_semi")).join(F.broadcast(there), same, "left_semi")
    order = W.partitionBy(*by, "_bin").orderBy("_key", "entity_id", "as_of_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = within.withColumns({f"{c}1": f.over(order) for c, f in sums.items()}).select(*[F.col(c).alias(f"{c}_") for c in (*by, "_bin")], "_n1", "_l1", "_p1")
    at = run.join(F.broadcast(found), [*same, F.col("_n0") + F.col("_n1") == F.col("k")])
    return _with_counts(at, F.col("l0") + F.col("_l0") + F.col("_l1"), F.col("p0") + F.col("_p0") + F.col("_p1")).select(*[c for c in open_.columns if c not in ("score", "m", "l", "p", "l0", "p0", "k")], "trial", "n_above", "tp", "fp", "fn", "tn")


def evaluate(pred: DataFrame, defs: DataFrame, trials: int = TRIALS, subset: DataFrame | None = None) -> DataFrame:
    """Best, worst and stochastic value of each metric and threshold for each model.

    Best and worst order ties by label; where they differ by more than 1 %, the stochastic value
    is the mean over random orders, with its deviation, else it is the worst value. Metrics of the scores
    (AUC, average precision) don't depend on an order of ties; with one class only they are null. A
    subset is taken before ranking. A metric without a definition is an error. Predictions are read
    for the score groups and, where ties matter, for the tied rows.
    """
    wanted = {r.metric for r in defs.select("metric").distinct().collect()}  # a config's rows
    for name in wanted:
        greater_is_better(name)
    rows = pred if subset is None else pred.join(subset.select("entity_id", "as_of_date").distinct(), ["entity_id", "as_of_date"], "left_semi")
    at, groups = _thresholds(defs), score_groups(rows)
    keys = ["model_id", "metric", "parameter"]
    around = cut(_around(groups, at), "around")
    worst, best = _extreme(around, "worst"), _extreme(around, "best")
    for name in sorted(wanted & set(SCORE_METRICS)):
        score = SCORE_METRICS[name](groups).toDF("model_id", name)
        worst, best = worst.join(score, "model_id", "left"), best.join(score, "model_id", "left")
    worst = metrics(worst, defs, "worst_value").select(*keys, "unit", "value", "beta", "worst_value", "n_labeled", "n_above", "n_positive")
    best = metrics(best, defs, "best_value").select(*keys, "best_value")
    both = worst.join(best, keys)
    close = F.col("best_value").isNull() | (F.abs(F.col("best_value") - F.col("worst_value")) <= CLOSE * F.greatest(F.abs("best_value"), F.abs("worst_value")))
    both = both.withColumn("_close", close)
    tried = metrics(tie_trials(rows, at, trials, groups), defs, "_t").groupBy(*keys).agg(F.avg("_t").alias("_mean"), F.stddev_samp("_t").alias("_sd"))
    return both.join(tried, keys, "left").select(
        *keys, "best_value", "worst_value",
        F.when(F.col("_close"), F.col("worst_value")).otherwise(F.col("_mean")).alias("stochastic_value"),
        F.when(F.col("_close"), F.lit(0.0)).otherwise(F.col("_sd")).alias("standard_deviation"),
        F.when(F.col("_close"), 0).otherwise(trials).alias("num_sort_trials"),
        F.col("n_labeled").alias("num_labeled_examples"), F.col("n_above").alias("num_labeled_above_threshold"), F.col("n_positive").alias("num_positive_labels"),
    )


def missing_evaluations(defs: DataFrame, models: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Configured metrics that a model has no stored value for."""
    wanted = models.select("model_id").distinct().crossJoin(F.broadcast(defs.select("metric", "parameter").distinct()))  # a config's rows
    return wanted.join(evaluations.filter("stochastic_value is not null"), ["model_id", "metric", "parameter"], "left_anti")
