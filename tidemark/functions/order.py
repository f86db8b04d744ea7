"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows of the same ``by`` up to and with each row in the order, by name.

    Rows are parted by ranges of ``by`` and the order, summed within their part, and shifted by the
    totals of the parts before: those are a row per part and per value of ``by``. The order should be
    total. A large group of one value of ``by`` lies in many parts.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id())
    parted = cut(parts.withColumns({f"_value{i}": v for i, v in enumerate(values.values())}), "ranges")
    totals = parted.groupBy("_part", *by).agg(*[F.sum(f"_value{i}").alias(f"_t{i}") for i in range(len(values))])
    w = W.partitionBy(*by).orderBy("_part")
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    before = totals.select(F.col("_part").alias("_at"), *keys, *[(F.sum(f"_t{i}").over(w) - F.col(f"_t{i}")).alias(f"_before{i}") for i in range(len(values))])
    within = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = [F.col("_part") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    rows = parted.withColumns({f"_within{i}": F.sum(f"_value{i}").over(within) for i in range(len(values))})
    # Not hinted: by many small groups the table of totals can be large.
    return rows.join(before if by else F.broadcast(before), same).select(*df.columns, *[(F.col(f"_before{i}") + F.col(f"_within{i}")).alias(n) for i, n in enumerate(values)])


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one in the order."""
    return running_totals(df, (), order, {name: value})


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 1 in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def value_ranks(df: DataFrame, value: Column, descending: bool = False) -> DataFrame:
    """``_v, n, rank, dense_rank`` for each distinct value: rank with gaps and dense rank, from 1. The
    table of values is numbered, not the rows."""
    counts = df.groupBy(value.alias("_v")).agg(F.count("*").alias("n"))
    order = [F.col("_v").desc() if descending else F.col("_v").asc()]
    with_rank = running_total(counts, order, F.col("n"), "_upto").withColumn("rank", F.col("_upto") - F.col("n") + 1).drop("_upto")
    return number_rows(with_rank, order, "dense_rank")


def exact_quantiles(df: DataFrame, cols: Sequence[str], p: float) -> DataFrame:
    """One row with the exact quantile ``p`` of each column, as doubles; between two values it is interpolated, without
    values it is null.

    Equal values of all columns are counted together, then numbered by ranges of column and value: only the two
    that the quantile lies between are looked at, and no task holds all values of a column.
    """
    tall = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).unpivot([], [f"c{i}" for i in range(len(cols))], "_c", "_v").filter("_v is not null")
    counts = tall.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    run = running_totals(counts, ["_c"], [F.col("_v").asc()], {"_upto": F.col("_n")})
    sizes = run.groupBy(F.col("_c").alias("_of")).agg(((F.sum("_n") - 1) * p).alias("_at"))  # a row per column
    near = run.join(F.broadcast(sizes), F.col("_c") == F.col("_of"))
    low, high, first = F.floor("_at"), F.ceil("_at"), F.col("_upto") - F.col("_n")
    holds = lambda k: (first <= k) & (k < F.col("_upto"))
    ends = near.filter(holds(low) | holds(high)).groupBy("_c").agg(F.max("_at").alias("_at"), F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    between = F.when(low == high, F.col("_a")).otherwise((high - F.col("_at")) * F.col("_a") + (F.col("_at") - low) * F.col("_b"))
    found = ends.select("_c", between.alias("_q"))
    return found.agg(*[F.max(F.when(F.col("_c") == f"c{i}", F.col("_q"))).alias(c) for i, c in enumerate(cols)])
