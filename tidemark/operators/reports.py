"""Summaries over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["entity_id", "as_of_date"]


def cohort_report(labels: DataFrame) -> DataFrame:
    """Cohort size and base rate by label, timespan and date."""
    return labels.groupBy("label_name", "label_timespan", "as_of_date").agg(F.count_distinct("entity_id").alias("cohort_size"), F.avg("label").alias("base_rate"))


def subset_report(labels: DataFrame, subset: DataFrame) -> DataFrame:
    """The same within a subset, the rate in percent."""
    inside = labels.join(subset.select(*KEYS).distinct(), KEYS, "left_semi")
    return inside.groupBy("label_name", "label_timespan", "as_of_date").agg(F.count_distinct("entity_id").alias("subset_size"), (F.avg("label") * 100).alias("base_rate_pct"))


def evaluation_cohort_summary(evals: DataFrame) -> DataFrame:
    """One row per evaluation start: labelled examples, positives, base rate."""
    w = W.partitionBy("evaluation_start_time").orderBy("model_id", "metric", "parameter")
    one = evals.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return one.select("evaluation_start_time", "num_labeled_examples", "num_positive_labels", F.try_divide(F.col("num_positive_labels"), F.col("num_labeled_examples")).alias("base_rate"))


def feature_missingness(imputed: DataFrame) -> DataFrame:
    """For each flag column: mean, least and greatest share (in percent) of imputed rows over dates."""
    flags = [c for c in imputed.columns if c.endswith("_imp")]
    per_date = imputed.groupBy("as_of_date").agg(*[(F.sum(F.col(f"`{c}`")) * 100 / F.count("*")).alias(c) for c in flags])
    tall = per_date.unpivot(["as_of_date"], [f"`{c}`" for c in flags], "feature", "pct")
    return tall.groupBy("feature").agg(F.avg("pct").alias("mean_pct"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"))


def group_summary(models: DataFrame) -> DataFrame:
    return models.groupBy("model_group_id", "model_type").agg(F.count_distinct("model_id").alias("n_models"), F.count_distinct("train_end_time").alias("n_splits"))


def model_performance(models: DataFrame, evals: DataFrame, metric: str, parameter: str) -> DataFrame:
    """Every model with its value, or null where it has none."""
    own = evals.filter((F.col("metric") == metric) & (F.col("parameter") == parameter)).select("model_id", F.col("stochastic_value").alias("value"))
    return models.select("model_id", "model_group_id", "train_end_time").distinct().join(own, "model_id", "left")


def subset_performance(models: DataFrame, evals: DataFrame, metric: str, parameter: str) -> DataFrame:
    """Values by subset; evaluations without one are those of the full cohort."""
    own = evals.filter((F.col("metric") == metric) & (F.col("parameter") == parameter)).select("model_id", F.coalesce("subset_hash", F.lit("full_cohort")).alias("subset"), F.col("stochastic_value").alias("value"))
    return models.select("model_id", "model_group_id", "train_end_time").distinct().join(own, "model_id", "left")


def efficiency_equity(models: DataFrame, evals: DataFrame, audit: DataFrame, metric: str, parameter: str, disparity: str) -> DataFrame:
    """Mean and standard error of value and disparity per model group and attribute value."""
    perf = model_performance(models, evals, metric, parameter)
    rows = perf.join(audit.select("model_id", "attribute_name", "attribute_value", F.col(f"{disparity}_disparity").alias("d")), "model_id", "left")
    return rows.groupBy("model_group_id", "attribute_name", "attribute_value").agg(
        F.avg("value").alias("mean_value"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem_value"),
        F.avg("d").alias("mean_disparity"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("sem_disparity"),
    )


def best_per_type(models: DataFrame, evals: DataFrame, metric: str, parameter: str) -> DataFrame:
    """The group with the best mean value of each model type."""
    perf = model_performance(models, evals, metric, parameter).join(models.select("model_id", "model_type", "hyperparameters").distinct(), "model_id")
    g = perf.groupBy("model_type", "model_group_id", "hyperparameters").agg(F.avg("value").alias("mean_value"))
    w = W.partitionBy("model_type").orderBy(F.col("mean_value").desc_nulls_last(), "model_group_id")
    return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_groups(models: DataFrame, evals: DataFrame, metric: str, parameter: str, n: int) -> DataFrame:
    g = model_performance(models, evals, metric, parameter).groupBy("model_group_id").agg(F.avg("value").alias("mean_value"))
    return g.orderBy(F.col("mean_value").desc_nulls_last(), "model_group_id").limit(n)


def experiment_stats(experiments: DataFrame) -> DataFrame:
    """One row of totals over experiments ``experiment_hash, n_models, n_matrices, status``."""
    done = F.when(F.col("status") == "completed", 1).otherwise(0)
    return experiments.agg(F.count("*").alias("n_experiments"), F.max("n_models").alias("most_models"), F.sum("n_models").alias("models"), F.sum("n_matrices").alias("matrices"), F.sum(done).alias("completed"))


def missing_artifacts(planned: DataFrame, built: DataFrame, key: str) -> DataFrame:
    return planned.select(key).distinct().join(built, key, "left_anti")


def models_for_groups(models: DataFrame, matrices: DataFrame, groups: list) -> DataFrame:
    """One model (the newest id) per group and time, with its train matrix and each test matrix."""
    w = W.partitionBy("model_group_id", "train_end_time").orderBy(F.col("model_id").desc())
    one = models.filter(F.col("model_group_id").isin(groups)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    kinds = {k: matrices.filter(F.col("matrix_type") == k).select("train_end_time", F.col("matrix_uuid").alias(f"{k}_matrix_uuid")) for k in ("train", "test")}
    return one.select("model_id", "model_group_id", "train_end_time").join(kinds["train"], "train_end_time").join(kinds["test"], "train_end_time")
