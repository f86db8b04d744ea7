"""Ranking of predictions with explicit tie rules."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.order import running_totals


def tie_key(seed: int | str | Column) -> Column:
    """A reproducible random key of a row, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(str(seed)), "entity_id", "as_of_date"))


def tie_order(rule: str, seed: int = 0) -> list[Column]:
    """Sort keys: score, then the tie rule. ``worst`` puts negatives first and unlabelled rows before
    them, ``best`` positives first and unlabelled rows last, ``random`` follows a seeded digest."""
    ties = {"worst": lambda: F.col("label").asc_nulls_first(), "best": lambda: F.col("label").desc_nulls_last(), "random": lambda: tie_key(seed).asc()}
    return [F.col("score").desc_nulls_last(), ties[rule](), F.col("entity_id").asc(), F.col("as_of_date").asc()]


def rank_small_models(pred: DataFrame, rule: str = "worst", seed: int = 0) -> DataFrame:
    """The ranks of ``rank_predictions`` where each model's rows fit in one task: nothing is written in between."""
    w = W.partitionBy("model_id")
    ordered, tied = w.orderBy(*tie_order(rule, seed)), w.orderBy(F.col("score").desc_nulls_last())
    return (
        pred.withColumn("rank_abs_no_ties", F.row_number().over(ordered).cast("long"))
        .withColumn("rank_abs_with_ties", F.rank().over(tied).cast("long"))
        .withColumn("rank_pct_no_ties", F.col("rank_abs_no_ties") / F.count("*").over(w))
        .withColumn("_dense", F.dense_rank().over(tied))
        .withColumn("rank_pct_with_ties", F.col("_dense") / F.max("_dense").over(w))
        .drop("_dense")
    )


def number_predictions(pred: DataFrame, rule: str = "worst", seed: int = 0) -> DataFrame:
    """Adds ``rank_abs_no_ties`` alone, where the other ranks are not asked for."""
    return running_totals(pred, ["model_id"], tie_order(rule, seed), {"rank_abs_no_ties": F.lit(1).cast("long")})


def rank_predictions(pred: DataFrame, rule: str = "worst", seed: int = 0) -> DataFrame:
    """Adds the four ranks of each model's rows: absolute and as a share, with and without ties. The
    share with ties is the dense rank over the number of distinct scores.

    Rows are numbered by ranges within their model, and tied ranks come from the table of distinct
    scores, so one model may have any number of rows.
    """
    one = F.lit(1).cast("long")
    numbered = number_predictions(pred, rule, seed)
    values = pred.groupBy("model_id", "score").agg(F.count("*").alias("_n"))
    ranks = running_totals(values, ["model_id"], [F.col("score").desc_nulls_last()], {"_upto": F.col("_n"), "_dense": one})
    top = ranks.groupBy(F.col("model_id").alias("_m")).agg(F.max("_dense").alias("_top"), F.sum("_n").alias("_all"))
    ranks = ranks.join(top, F.col("model_id").eqNullSafe(F.col("_m"))).select("_m", F.col("score").alias("_v"), (F.col("_upto") - F.col("_n") + 1).alias("rank_abs_with_ties"), "_all", (F.col("_dense") / F.col("_top")).alias("rank_pct_with_ties"))
    return numbered.join(ranks, [F.col("model_id").eqNullSafe(F.col("_m")), F.col("score").eqNullSafe(F.col("_v"))]).select(
        *pred.columns, "rank_abs_no_ties", "rank_abs_with_ties", (F.col("rank_abs_no_ties") / F.col("_all")).alias("rank_pct_no_ties"), "rank_pct_with_ties"
    )


def top_k(pred: DataFrame, rank_col: str, k: float) -> DataFrame:
    return pred.filter(F.col(rank_col) <= k)


RANKS = ("rank_abs_no_ties", "rank_abs_with_ties", "rank_pct_no_ties", "rank_pct_with_ties")


def missing_predictions(models: DataFrame, pred: DataFrame, dates: DataFrame, tie_rule: str | None = None) -> DataFrame:
    """(model, date) without predictions, with a row that lacks one of the ranks that are stored, or ranked by another
    ``tie_rule`` than the one asked for."""
    faults = [F.col(c).isNull() for c in RANKS if c in pred.columns]
    if tie_rule is not None:
        faults.append(~F.col("tie_rule").eqNullSafe(F.lit(tie_rule)))
    done = pred.groupBy("model_id", "as_of_date").agg(F.bool_or(reduce(operator.or_, faults, F.lit(False))).alias("_gap")).filter("not _gap")
    return models.select("model_id").crossJoin(F.broadcast(dates.select("as_of_date").distinct())).join(done, ["model_id", "as_of_date"], "left_anti")  # a list of dates


def fallback_ranks(pred: DataFrame) -> DataFrame:
    """Stored ranks, or where they are missing the row number and percentile by score within model and date.

    Rows are numbered by ranges. Of n rows in 100 tiles the first n % 100 tiles have one row more, so a tile follows from
    the number.
    """
    by = ["model_id", "as_of_date"]
    numbered = running_totals(pred, by, [F.col("score").desc(), F.col("entity_id").asc()], {"_nth": F.lit(1).cast("long")})
    sizes = pred.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_n"))
    rows = numbered.join(sizes, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    small, more = F.floor(F.col("_n") / 100), F.col("_n") % 100
    long_tiles = more * (small + 1)  # rows in tiles with one row more
    tile = F.when(F.col("_nth") <= long_tiles, F.floor((F.col("_nth") - 1) / (small + 1)) + 1).otherwise(more + F.floor((F.col("_nth") - long_tiles - 1) / F.greatest(small, F.lit(1))) + 1)
    return rows.select(*by, "entity_id", "score", F.coalesce("rank_abs_no_ties", F.col("_nth")).alias("rank_abs"), F.coalesce(F.col("rank_pct_no_ties") * 100, tile).cast("double").alias("rank_pct"))
