"""Rule-based and simple learned scorers."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import exact_quantiles, value_ranks
from tidemark.sources.scratch import cut

_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}


def rule_column(rule: str | dict) -> Column:
    """``"x1 > 0"`` or ``{"x1 > 0"-like parts}`` as a condition; a null compares as false."""
    if isinstance(rule, dict):
        feature, sign, threshold = rule["feature_name"], rule["operator"], rule["threshold"]
    else:
        found = re.fullmatch(r"\s*(.+?)\s*(>=|<=|==|>|<)\s*(-?[\d.]+)\s*", rule)
        if not found:
            raise ValueError(f"not a rule: {rule!r}")
        feature, sign, threshold = found[1], found[2], float(found[3])
    return F.coalesce(_OPS[sign](F.col(f"`{feature}`"), F.lit(threshold)), F.lit(False))


def score_thresholds(df: DataFrame, rules: Sequence[str | dict], how: str = "or") -> DataFrame:
    """Score 1 where any (``or``) or every (``and``) rule holds, else 0."""
    join = operator.or_ if how == "or" else operator.and_
    return df.withColumn("score", reduce(join, map(rule_column, rules)).cast("int"))


def score_percentile_rank(df: DataFrame, col: str, low_value_high_score: bool = False) -> DataFrame:
    """Share of rows strictly below (or above) in one feature. Distinct values are ranked, not rows."""
    ranks = value_ranks(df, F.col(f"`{col}`"), descending=low_value_high_score)
    total = df.agg(F.count("*").alias("_n"))
    placed = df.join(ranks.select("_v", "rank"), F.col(f"`{col}`").eqNullSafe(F.col("_v"))).crossJoin(F.broadcast(total))  # one row
    return placed.withColumn("score", (F.col("rank") - 1) / F.col("_n")).drop("_v", "rank", "_n")


def score_multi_rank(df: DataFrame, rules: Sequence[tuple[str, bool]]) -> DataFrame:
    """Dense rank by several features, ``(name, low values score high)``, scaled to 0 to 1 by the
    highest rank; null when all rows tie."""
    keys = [F.when(F.col(f"`{c}`").isNotNull(), -F.col(f"`{c}`") if low else F.col(f"`{c}`")).alias(f"k{i}") for i, (c, low) in enumerate(rules)]
    ranks = value_ranks(df, F.struct(*keys)).select("_v", (F.col("dense_rank") - 1).alias("_r"))
    top = ranks.agg(F.max("_r").alias("_top"))
    return df.withColumn("_k", F.struct(*keys)).join(ranks, F.col("_k") == F.col("_v")).crossJoin(F.broadcast(top)).withColumn("score", F.try_divide(F.col("_r"), F.col("_top"))).drop("_k", "_v", "_r", "_top")


def score_linear(df: DataFrame, cols: Sequence[str], weights: Sequence[float], approx: bool = False) -> DataFrame:
    """Weighted sum of features, each capped at its 99th percentile and divided by it (unless that
    is 0); weights are scaled to sum 1."""
    total = sum(weights)
    if approx:
        caps = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), 0.99, 10_000).alias(f"_cap{i}") for i, c in enumerate(cols)])
    else:
        caps = exact_quantiles(df, cols, 0.99).toDF(*[f"_cap{i}" for i in range(len(cols))])
    parts = [F.when(F.col(f"_cap{i}") == 0, F.least(F.col(f"`{c}`"), F.col(f"_cap{i}"))).otherwise(F.least(F.col(f"`{c}`"), F.col(f"_cap{i}")) / F.col(f"_cap{i}")) * (w / total) for i, (c, w) in enumerate(zip(cols, weights, strict=True))]
    return df.crossJoin(F.broadcast(caps)).withColumn("score", reduce(operator.add, parts)).drop(*[f"_cap{i}" for i in range(len(cols))])


def fit_min_max(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``_min_c, _max_c``."""
    return train.agg(*[f(F.col(f"`{c}`")).alias(f"_{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def apply_min_max(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaled by the training range and clipped to [0, 1]; a constant column has range 1."""

    def scaled(c: str) -> Column:
        low, high = F.col(f"`_min_{c}`"), F.col(f"`_max_{c}`")
        width = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"`{c}`") - low) / width))

    return df.crossJoin(F.broadcast(stats)).select(*[scaled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])  # one row of statistics


def score_prior(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training label rate for every row."""
    return test.crossJoin(F.broadcast(train.agg(F.avg("label").alias("score"))))


def train_scaled_lr(train: DataFrame, cols: Sequence[str], **params):
    """Logistic regression on min–max scaled features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="error"), MinMaxScaler(inputCol="_raw", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="label", **params)]
    return Pipeline(stages=stages).fit(train)


def flatten_grid(grid: dict[str, dict[str, Sequence]]) -> list[tuple[str, dict]]:
    """``{kind: {parameter: values}}`` to every combination."""
    return [(kind, dict(zip(params, values, strict=True))) for kind, params in grid.items() for values in product(*params.values())]


#: Training rows of a task at most, about. A tree's fit on three features keeps some 140 bytes for each and reads them for each level.
ROWS_A_TASK = 250_000


def spread(data: DataFrame, n_rows: int) -> DataFrame:
    """A written table of ``n_rows`` dealt over more tasks where one of them would have too many to train on: files are
    small where rows are not, so the number of files says little."""
    parts = -(-n_rows // ROWS_A_TASK)
    return data if data.rdd.getNumPartitions() >= parts else data.repartition(parts)


def train_grid(train: DataFrame, cols: Sequence[str], grid: dict[str, dict[str, Sequence]]) -> list[tuple[str, dict, object]]:
    """A model for each point of the grid, in its order. Fits run on the cluster, four at a time."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kinds = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosted": GBTClassifier, "logistic": LogisticRegression}
    assembler = VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="error")
    if train.isEmpty():
        raise ValueError("no rows to train on")
    data = cut(train.select("label", *[F.col(f"`{c}`") for c in cols]), "train")
    data = spread(data, data.count())

    def fit(point: tuple[str, dict]) -> tuple[str, dict, object]:
        kind, params = point
        return kind, params, Pipeline(stages=[assembler, kinds[kind](featuresCol="_features", labelCol="label", **params)]).fit(data)

    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(fit, flatten_grid(grid)))


def score_grid(models: Sequence, matrix: DataFrame) -> DataFrame:
    """``model_id`` (from 0), ``entity_id, as_of_date, score, label``: each row by all models, in one pass over the matrix.

    The score is the probability of class 1; 0 by a model that saw class 0 only, null for a row with a null feature.
    """
    from pyspark.ml.functions import vector_to_array

    used = [m.stages[0].getInputCols() for m in models]
    there = {c: F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) for cols in used for c in cols}
    whole = [reduce(operator.and_, [there[c] for c in cols]).alias(f"_whole{i}") for i, cols in enumerate(used)]
    rows = matrix.select("entity_id", "as_of_date", "label", *whole, *[F.when(has, F.col(f"`{c}`")).otherwise(F.lit(0)).alias(c) for c, has in there.items()])
    one = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    for i, model in enumerate(models):
        rows = model.transform(rows).withColumn(f"_score{i}", F.when(F.col(f"_whole{i}"), one)).drop("_features", "rawPrediction", "probability", "prediction")
    scores = F.array(*[F.struct(F.lit(i).alias("model_id"), F.col(f"_score{i}").alias("score")) for i in range(len(models))])
    return rows.withColumn("_s", F.explode(scores)).select("_s.model_id", "entity_id", "as_of_date", "_s.score", "label")


def score(model, matrix: DataFrame) -> DataFrame:
    """The same by one model: ``entity_id, as_of_date, score, label``."""
    return score_grid([model], matrix).drop("model_id")
