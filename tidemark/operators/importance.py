"""Feature importances of models and of single predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_importances(df: DataFrame) -> DataFrame:
    """Dense rank of features per model by importance, largest first, absolute and as a share."""
    w = W.partitionBy("model_id")
    ranked = df.withColumn("feature_importance", F.round("feature_importance", 10)).withColumn("rank_abs", F.dense_rank().over(w.orderBy(F.col("feature_importance").desc())))
    return ranked.withColumn("rank_pct", F.round(F.col("rank_abs") / F.max("rank_abs").over(w), 10))


def top_features(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` features of each model with the largest importance other than 0."""
    w = W.partitionBy("model_id").orderBy(F.col("feature_importance").desc(), "feature")
    return df.filter("feature_importance <> 0").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def group_importances(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Largest absolute importance by the first prefix that a feature has."""
    group = F.lit("No feature group")
    for p in reversed(prefixes):
        group = F.when(F.col("feature").startswith(p), p).otherwise(group)
    return df.groupBy("model_id", group.alias("feature_group")).agg(F.max(F.abs("feature_importance")).alias("importance"))


def individual_importance(matrix: DataFrame, importances: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Uniform method: each entity gets the model's top features with their values and importances. Columns ``by`` of both
    say which rows a model is for."""
    keys = ["entity_id", "as_of_date", *by]
    top = top_features(importances, n).select("model_id", *by, "feature", F.col("feature_importance").alias("importance_score"))
    names = [r.feature for r in top.select("feature").distinct().orderBy("feature").collect()]  # n for each model
    tall = matrix.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(keys, [f"`{c}`" for c in names], "feature", "feature_value")
    return tall.join(F.broadcast(top), ["feature", *by]).select("model_id", "entity_id", "as_of_date", "feature", F.lit("uniform").alias("method"), "feature_value", "importance_score")


def importance_summary(df: DataFrame, n: int) -> DataFrame:
    """Mean and standard error of a feature's importance over a group's models; top ``n`` per group."""
    g = df.groupBy("model_group_id", "feature").agg(F.avg("feature_importance").alias("mean_importance"), (F.stddev_samp("feature_importance") / F.sqrt(F.count("*"))).alias("sem"))
    w = W.partitionBy("model_group_id").orderBy(F.col("mean_importance").desc(), "feature")
    return g.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
