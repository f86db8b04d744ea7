"""Tables that the queries derive from the given ones, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries of a module by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for sums depend on their order; counts as longs."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), digits).alias(c) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(f"`{c}`").cast("long").alias(c) if kinds[c] in ("int", "tinyint", "smallint") else F.col(f"`{c}`") for c in df.columns])


EVENT_DATES = [date(2024, 1, d) for d in (8, 15, 22, 29)]
YEARS = [date(y, 1, 1) for y in range(1997, 2002)]
AS_OF = "SELECT unnest([DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-29']) AS as_of_date"
YEARS_SQL = "SELECT unnest([DATE '1997-01-01', DATE '1998-01-01', DATE '1999-01-01', DATE '2000-01-01', DATE '2001-01-01']) AS as_of_date"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Scores with ties and missing labels: seven models over orders."""
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("model_id"), F.col("l_orderkey").alias("entity_id"))
    return rows.agg(F.max("l_discount").alias("score"), F.max(flag).alias("label")).select("model_id", "entity_id", F.lit(date(1998, 1, 1)).alias("as_of_date"), "score", "label")


PRED = """pred AS (
  SELECT l_linenumber::BIGINT AS model_id, l_orderkey AS entity_id, DATE '1998-01-01' AS as_of_date, max(l_discount) AS score,
         max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS label
  FROM lineitem GROUP BY l_linenumber, l_orderkey)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Four numeric features of each order."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id"))
    return rows.agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_tax"), 8).alias("tax"), F.count("*").cast("double").alias("lines"), F.max("l_partkey").cast("double").alias("part")).withColumn("as_of_date", F.lit(date(1998, 1, 1)))


MATRIX = """matrix AS (
  SELECT l_orderkey AS entity_id, sum(l_quantity) AS quantity, round(avg(l_tax), 8) AS tax, count(*)::DOUBLE AS lines, max(l_partkey)::DOUBLE AS part,
         DATE '1998-01-01' AS as_of_date FROM lineitem GROUP BY l_orderkey)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    """A model per line number and year; three groups."""
    line, year = F.col("l_linenumber").cast("long"), F.year("l_shipdate").cast("long")
    return table(spark, d, "lineitem").select((line * 10000 + year).alias("model_id"), ((line - 1) % 3 + 1).alias("model_group_id"), F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("train_end_time"), F.when((line - 1) % 3 == 0, "tree").otherwise("logistic").alias("model_type"), F.concat(F.lit('{"depth": '), ((line - 1) % 3 + 1).cast("string"), F.lit("}")).alias("hyperparameters")).distinct()


MODELS = """models AS (
  SELECT DISTINCT l_linenumber::BIGINT * 10000 + year(l_shipdate) AS model_id, (l_linenumber::BIGINT - 1) % 3 + 1 AS model_group_id,
         make_date(year(l_shipdate), 1, 1) AS train_end_time, CASE WHEN (l_linenumber - 1) % 3 = 0 THEN 'tree' ELSE 'logistic' END AS model_type,
         '{"depth": ' || ((l_linenumber - 1) % 3 + 1)::VARCHAR || '}' AS hyperparameters FROM lineitem)"""


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics per model, and a later evaluation of each that must not count."""
    line, year = F.col("l_linenumber").cast("long"), F.year("l_shipdate").cast("long")
    g = table(spark, d, "lineitem").groupBy((line * 10000 + year).alias("model_id"), F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("evaluation_start_time"))
    wide = g.agg(F.round(F.avg("l_discount") * 10, 6).alias("p"), F.round(F.avg("l_tax") * 10, 6).alias("r"), F.count("*").alias("num_labeled_examples"), F.count_if(F.col("l_returnflag") == "R").alias("num_positive_labels"))
    kinds = F.array(F.struct(F.lit("precision@").alias("metric"), F.col("p").alias("v")), F.struct(F.lit("recall@").alias("metric"), F.col("r").alias("v")))
    tall = wide.withColumn("m", F.explode(kinds))
    cols = ["model_id", F.col("m.metric").alias("metric"), F.lit("100_abs").alias("parameter"), "num_labeled_examples", "num_positive_labels"]
    first = tall.select(*cols, "evaluation_start_time", F.add_months("evaluation_start_time", 1).alias("evaluation_end_time"), F.col("m.v").alias("stochastic_value"))
    later = tall.select(*cols, F.add_months("evaluation_start_time", 2), F.add_months("evaluation_start_time", 3), F.lit(-0.15))
    return first.union(later)


EVALS = """wide AS (
  SELECT l_linenumber::BIGINT * 10000 + year(l_shipdate) AS model_id, make_date(year(l_shipdate), 1, 1) AS t, round(avg(l_discount) * 10, 6) AS p,
         round(avg(l_tax) * 10, 6) AS r, count(*) AS num_labeled_examples, count(*) FILTER (WHERE l_returnflag = 'R') AS num_positive_labels
  FROM lineitem GROUP BY ALL
), tall AS (
  SELECT * EXCLUDE (p, r), 'precision@' AS metric, p AS v FROM wide UNION ALL SELECT * EXCLUDE (p, r), 'recall@', r FROM wide
), evals AS (
  SELECT model_id, metric, '100_abs' AS parameter, num_labeled_examples, num_positive_labels, t AS evaluation_start_time,
         (t + INTERVAL 1 MONTH)::DATE AS evaluation_end_time, v AS stochastic_value FROM tall
  UNION ALL
  SELECT model_id, metric, '100_abs', num_labeled_examples, num_positive_labels, (t + INTERVAL 2 MONTH)::DATE, (t + INTERVAL 3 MONTH)::DATE, -0.15 FROM tall)"""


def importances(spark: SparkSession, d: str) -> DataFrame:
    """A feature per supplier modulo 12 for each of seven models."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("model_id"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "even_").otherwise("odd_"), (F.col("l_suppkey") % 12).cast("string")).alias("feature"))
    return g.agg(F.round(F.avg("l_tax") * 10, 4).alias("feature_importance"))


IMPORTANCES = """imp AS (
  SELECT l_linenumber::BIGINT AS model_id, CASE WHEN l_suppkey % 2 = 0 THEN 'even_' ELSE 'odd_' END || (l_suppkey % 12)::VARCHAR AS feature,
         round(avg(l_tax) * 10, 4) AS feature_importance FROM lineitem GROUP BY ALL)"""
