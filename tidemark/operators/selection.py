"""Model groups over time: distance from the best, thresholds, selection rules and regrets.

All rules share one form: ``rule(history) -> (model_group_id, value)`` scores where ``history`` has
rows ``as_of_time, train_end_time <= as_of_time``; the group with the best value is picked for every
``as_of_time`` at once, ties going to the lowest group. Nothing of the future reaches a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.evaluate import METRICS, greater_is_better
from tidemark.sources.scratch import cut

SERIES = ["model_group_id", "metric", "parameter"]


def better_is_greater(metric: Column) -> Column:
    return ~metric.isin([name for name, (_, up) in METRICS.items() if not up])


def assign_model_groups(models: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Models with their group: same type, hyperparameters, set of features and config. Known groups
    keep their ids, new ones follow."""
    key = F.md5(F.concat_ws("\x1f", "model_type", "hyperparameters", F.concat_ws(",", F.array_sort("feature_list")), "model_config"))
    keyed = models.withColumn("group_key", key)
    groups = keyed.select("group_key").distinct()
    if existing is None:
        # One row per group: models are few next to data.
        ids = groups.withColumn("model_group_id", F.row_number().over(W.orderBy("group_key")))
    else:
        top = existing.agg(F.coalesce(F.max("model_group_id"), F.lit(0)).alias("_top"))
        new = groups.join(existing, "group_key", "left_anti").withColumn("_n", F.row_number().over(W.orderBy("group_key"))).crossJoin(F.broadcast(top))
        ids = existing.select("group_key", "model_group_id").unionByName(new.select("group_key", (F.col("_n") + F.col("_top")).alias("model_group_id")))
    return keyed.join(ids, "group_key")


def select_groups(groups: DataFrame, label_name: str | None = None, baselines: Sequence[str] = (), baseline: bool | None = None) -> DataFrame:
    """Distinct groups by the label in their config (JSON), and by being a baseline or not."""
    out = groups
    if label_name is not None:
        out = out.filter(F.get_json_object("model_config", "$.label_name") == label_name)
    if baseline is not None:
        out = out.filter(F.col("model_type").isin(list(baselines)) == baseline)
    return out.select("model_group_id").distinct()


def train_end_times(models: DataFrame, after=None) -> DataFrame:
    out = models if after is None else models.filter(F.col("train_end_time") >= after)
    return out.select("train_end_time").distinct()


def filter_complete_groups(models: DataFrame, times: Sequence) -> DataFrame:
    """Groups that have a model at each of the times."""
    have = models.filter(F.col("train_end_time").isin(list(times))).groupBy("model_group_id").agg(F.count_distinct("train_end_time").alias("n"))
    return have.filter(F.col("n") == len(set(times))).select("model_group_id")


def distance_from_best(evals: DataFrame, models: DataFrame, how: str = "mean", baselines: Sequence = ()) -> DataFrame:
    """Per group, time and metric: value, best value of that time, distance, and both one time later.

    Each model counts with its first evaluation; models of one group and time are averaged, or the
    best or worst is taken.
    """
    w = W.partitionBy("model_id", "metric", "parameter").orderBy("evaluation_start_time", "evaluation_end_time")
    first = evals.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    up = better_is_greater(F.col("metric"))
    rows = first.join(models.select("model_id", "model_group_id", "train_end_time"), "model_id")
    least, most = F.min("stochastic_value"), F.max("stochastic_value")
    by = rows.groupBy(*SERIES, "train_end_time").agg(F.avg("stochastic_value").alias("mean"), F.when(up, most).otherwise(least).alias("best"), F.when(up, least).otherwise(most).alias("worst"))
    values = by.select(*SERIES, "train_end_time", F.col(how).alias("raw_value"))
    at = W.partitionBy("metric", "parameter", "train_end_time")
    counts = values.filter(~F.col("model_group_id").isin(list(baselines))) if baselines else values
    best = counts.select("metric", "parameter", "train_end_time", F.when(up, F.max("raw_value").over(at)).otherwise(F.min("raw_value").over(at)).alias("best_case")).distinct()
    nxt = W.partitionBy(*SERIES).orderBy("train_end_time")
    return (
        values.join(best, ["metric", "parameter", "train_end_time"])
        .withColumn("dist_from_best_case", F.abs(F.col("best_case") - F.col("raw_value")))
        .withColumns({"raw_value_next_time": F.lead("raw_value").over(nxt), "dist_from_best_case_next_time": F.lead("dist_from_best_case").over(nxt)})
        .select(*SERIES, "train_end_time", "raw_value", "best_case", "dist_from_best_case", "raw_value_next_time", "dist_from_best_case_next_time")
    )


def observed_bounds(dist: DataFrame) -> DataFrame:
    """Least and greatest value per metric, and bounds for a plot: 0 to 1, or 10 % around."""
    b = dist.groupBy("metric", "parameter").agg(F.min("raw_value").alias("observed_min"), F.max("raw_value").alias("observed_max"))
    unit = (F.col("observed_min") >= 0) & (F.col("observed_max") <= 1)
    pad = 0.1 * (F.col("observed_max") - F.col("observed_min"))
    return b.withColumns({"plot_min": F.when(unit, 0.0).otherwise(F.col("observed_min") - pad), "plot_max": F.when(unit, 1.0).otherwise(F.col("observed_max") + pad)})


def _grid(df: DataFrame, name: str, top: float, steps: int = 101) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(i * (top / (steps - 1)), 10))
    return df.withColumn(name, F.explode(points))


def best_distance_curve(dist: DataFrame, top: float = 1.0) -> DataFrame:
    """For 101 distances, the share of times at which a group is within that distance of the best."""
    return _grid(dist, "distance", top).groupBy(*SERIES, "distance").agg(F.avg((F.col("dist_from_best_case") <= F.col("distance")).cast("int")).alias("pct_of_time"))


def threshold_groups(dist: DataFrame, filters: Sequence[dict], times: Sequence) -> DataFrame:
    """Groups that pass the absolute threshold at every time for every filter, and come within
    ``max_from_best`` at some time for all filters at once."""
    rows = dist.filter(F.col("train_end_time").isin(list(times)))
    up = better_is_greater(F.col("metric"))
    table = [(f["metric"], f["parameter"], float(f["max_from_best"]), float(f["threshold_value"])) for f in filters]
    spec = rows.sparkSession.createDataFrame(table, "metric string, parameter string, max_from_best double, threshold_value double")
    joined = rows.join(F.broadcast(spec), ["metric", "parameter"])
    past = F.when(up, F.col("raw_value") >= F.col("threshold_value")).otherwise(F.col("raw_value") <= F.col("threshold_value"))
    at_time = joined.groupBy("model_group_id", "train_end_time").agg(F.every(past).alias("past"), F.every(F.col("dist_from_best_case") < F.col("max_from_best")).alias("close"), F.count("*").alias("n"))
    full = at_time.withColumns({"past": F.col("past") & (F.col("n") == len(filters)), "close": F.col("close") & (F.col("n") == len(filters))})
    return full.groupBy("model_group_id").agg(F.every("past").alias("p"), F.bool_or("close").alias("c"), F.count("*").alias("t")).filter((F.col("t") == len(set(times))) & F.col("p") & F.col("c")).select("model_group_id")


def history(dist: DataFrame) -> DataFrame:
    """Each row once for each time that can see it; next-time values are taken away."""
    times = dist.select(F.col("train_end_time").alias("as_of_time")).distinct()
    seen = dist.drop("raw_value_next_time", "dist_from_best_case_next_time")
    return seen.join(F.broadcast(times), F.col("train_end_time") <= F.col("as_of_time"))  # a short list of times


def _one(h: DataFrame, metric: str, parameter: str) -> DataFrame:
    return h.filter((F.col("metric") == metric) & (F.col("parameter") == parameter))


def _signed(metric: str) -> int:
    return 1 if greater_is_better(metric) else -1


BY = ["as_of_time", "model_group_id"]


def rule_random(h: DataFrame, metric: str, parameter: str, seed: int = 0) -> DataFrame:
    return _one(h, metric, parameter).select(*BY).distinct().withColumn("value", F.md5(F.concat_ws("|", F.lit(str(seed)), "model_group_id")))


def rule_best_current(h: DataFrame, metric: str, parameter: str) -> DataFrame:
    return _one(h, metric, parameter).filter("train_end_time = as_of_time").select(*BY, (F.col("raw_value") * -_signed(metric)).alias("value"))


def rule_best_average(h: DataFrame, metric: str, parameter: str) -> DataFrame:
    return _one(h, metric, parameter).groupBy(*BY).agg((F.avg("raw_value") * -_signed(metric)).alias("value"))


def rule_lowest_variance(h: DataFrame, metric: str, parameter: str) -> DataFrame:
    """The group with the least deviation over time. While no group has one yet (a single value each) all tie, and the
    lowest group stands for a random pick; a time at which only some have one is an error, for they can't be compared."""
    by = _one(h, metric, parameter).groupBy(*BY).agg(F.stddev_samp("raw_value").alias("_sd"))
    w = W.partitionBy("as_of_time")  # the groups of a time
    known = F.count("_sd").over(w)
    fault = F.raise_error(F.concat(F.lit("groups without a deviation beside others at "), F.col("as_of_time").cast("string"))).cast("double")
    return by.withColumn("value", F.when((known == 0) | (known == F.count("*").over(w)), F.col("_sd")).otherwise(fault)).select(*BY, "value")


def rule_most_frequent_best(h: DataFrame, metric: str, parameter: str, within: float = 0.05) -> DataFrame:
    return _one(h, metric, parameter).groupBy(*BY).agg((-F.avg((F.col("dist_from_best_case") <= within).cast("int"))).alias("value"))


def rule_two_metrics(h: DataFrame, metric: str, parameter: str, other: tuple[str, str] = ("recall@", "100_abs"), weight: float = 0.5) -> DataFrame:
    first = _one(h, metric, parameter).withColumn("_w", F.lit(weight * _signed(metric)))
    second = _one(h, *other).withColumn("_w", F.lit((1 - weight) * _signed(other[0])))
    each = first.unionByName(second).groupBy(*BY, "train_end_time").agg(F.sum(F.col("raw_value") * F.col("_w")).alias("v"))
    return each.groupBy(*BY).agg((-F.avg("v")).alias("value"))


def rule_var_penalized(h: DataFrame, metric: str, parameter: str, penalty: float = 0.5) -> DataFrame:
    g = _one(h, metric, parameter).groupBy(*BY).agg(F.avg("raw_value").alias("m"), F.coalesce(F.stddev_samp("raw_value"), F.lit(0.0)).alias("s"))
    extra = F.col("s") - F.min("s").over(W.partitionBy("as_of_time"))
    return g.withColumn("value", -(F.col("m") * _signed(metric) - penalty * extra)).select(*BY, "value")


def rule_recency(h: DataFrame, metric: str, parameter: str, curr_weight: float = 5.0, decay: str = "linear") -> DataFrame:
    """Weights fall from ``curr_weight`` at the newest time to 1 at the oldest."""
    w = W.partitionBy("as_of_time")
    age = F.datediff(F.col("train_end_time"), F.min("train_end_time").over(w))
    share = F.coalesce(F.try_divide(age, F.max("train_end_time").over(w).cast("date").cast("timestamp").cast("long") / 86400 - F.min("train_end_time").over(w).cast("date").cast("timestamp").cast("long") / 86400), F.lit(0.0))
    weight = 1 + (curr_weight - 1) * share if decay == "linear" else F.pow(F.lit(curr_weight), share)
    rows = _one(h, metric, parameter).withColumn("_w", weight)
    return rows.groupBy(*BY).agg((F.sum(F.col("raw_value") * F.col("_w")) / F.sum("_w") * -_signed(metric)).alias("value"))


RULES: dict[str, Callable[..., DataFrame]] = {
    "random_model_group": rule_random, "best_current_value": rule_best_current, "best_average_value": rule_best_average, "lowest_metric_variance": rule_lowest_variance,
    "most_frequent_best_dist": rule_most_frequent_best, "best_average_two_metrics": rule_two_metrics, "best_avg_var_penalized": rule_var_penalized, "best_avg_recency_weight": rule_recency,
}


def picks(scored: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` groups with the least value at each time, ties to the lowest id."""
    w = W.partitionBy("as_of_time").orderBy(F.col("value").asc_nulls_last(), "model_group_id")
    return scored.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("as_of_time", "nth", "model_group_id")


def rule_grid(spec: Sequence[dict]) -> list[tuple[str, str, dict]]:
    """Compact grids ``{selection_rules: [{name, param: [..]}], shared_parameters: [{metric: .., parameter: ..}]}``
    to (label, rule, arguments)."""
    out = []
    for block in spec:
        for shared, rule in product(block["shared_parameters"], block["selection_rules"]):
            lists = {k: v if isinstance(v, list) else [v] for k, v in rule.items() if k != "name"}
            for values in product(*lists.values()):
                args = dict(zip(lists, values, strict=True))
                label = "_".join([rule["name"], shared["metric"], shared["parameter"], *[f"{v}_{k}" for k, v in args.items()]])
                out.append((label, rule["name"], {**shared, **args}))
    return out


def rule_picks(dist: DataFrame, grid: Sequence[tuple[str, str, dict]], n: int = 1) -> DataFrame:
    """``rule, as_of_time, nth, model_group_id`` for each rule of a grid and each time."""
    h = cut(history(dist), "history")  # one plan of distances for all rules
    return reduce(DataFrame.unionByName, [picks(RULES[rule](h, **args), n).withColumn("rule", F.lit(label)) for label, rule, args in grid])


def rule_winners(dist: DataFrame, grid: Sequence[tuple[str, str, dict]], n: int = 1) -> DataFrame:
    """What each rule picks at the last time."""
    last = dist.agg(F.max("train_end_time").alias("as_of_time"))
    return rule_picks(dist, grid, n).join(F.broadcast(last), "as_of_time")


def rule_regrets(dist: DataFrame, grid: Sequence[tuple[str, str, dict]], metric: str, parameter: str) -> DataFrame:
    """For each rule and time: the pick, and how far from the best it is one time later."""
    nxt = _one(dist, metric, parameter).filter("raw_value_next_time is not null").select("model_group_id", F.col("train_end_time").alias("as_of_time"), F.col("dist_from_best_case_next_time").alias("regret"), "raw_value_next_time")
    return rule_picks(dist, grid).join(nxt, ["model_group_id", "as_of_time"]).select("rule", "as_of_time", "model_group_id", "regret", "raw_value_next_time")


def average_regret(regrets: DataFrame) -> DataFrame:
    return regrets.groupBy("rule").agg(F.avg("regret").alias("average_regret"), F.count("*").alias("n_times"))


def regret_curve(regrets: DataFrame, top: float = 1.0) -> DataFrame:
    """Share of times with a regret strictly under each of 101 values."""
    return _grid(regrets, "regret_at", top).groupBy("rule", "regret_at").agg(F.avg((F.col("regret") < F.col("regret_at")).cast("int")).alias("pct_of_time"))


def group_performance(dist: DataFrame, groups: Sequence, metric: str, parameter: str) -> DataFrame:
    """A series per group, and one of the best case of each time."""
    rows = _one(dist, metric, parameter)
    own = rows.filter(F.col("model_group_id").isin(list(groups))).select(F.col("model_group_id").cast("string").alias("series"), "train_end_time", F.col("raw_value").alias("value"))
    return own.union(rows.select(F.lit("best case"), "train_end_time", "best_case")).distinct()
