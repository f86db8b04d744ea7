"""Sources by table or query, and stores of matrices, predictions and result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut


def read_source(spark: SparkSession, sf_dir: str | None = None, table: str | None = None, query: str | None = None, **tables: DataFrame) -> DataFrame:
    """A Parquet table of a folder, a catalog table, or a query; ``tables`` are named in it as ``{name}``, so that
    no name is left in the session. ``read_jdbc`` reads from a database."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    if query is not None:
        return spark.sql(query, **tables)
    return spark.table(table) if sf_dir is None else spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 64, **options: str) -> DataFrame:
    """A database table read by ``parts`` tasks, each with a range of the integer ``key`` between ``bounds`` (rows
    outside fall to the first and last task, nulls to the first). Filters and columns are pushed to the database."""
    spread = {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts, "fetchsize": 10_000}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **{k: str(v) for k, v in spread.items()}, **options).load()


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a source that many plans read, and reads it back."""
    if path is None:
        return cut(df, "source")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or gzipped CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True, compression="gzip")


def read_matrix(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.parquet(path) if fmt == "parquet" else reader.csv(path, header=True)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("model_id",)) -> None:
    """Replaces the partitions ``by`` that ``df`` has and leaves the others. Rows of a partition are brought together
    as far as a task can take them: a large one is several files."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by (model, date)."""
    write_results(df, path, ("model_id", "as_of_date"))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing rows without those whose keys come anew, and the new ones. Of new rows with one key the last by
    ``order`` stays; rows alike in that go by their other columns, so that the result is the same in each run."""
    rest = [c for c in new.columns if c not in {*keys, *order}]
    last = new.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")) if order or rest else new.distinct()
    fresh = last.select(*[c if c in keys else F.col("_last").getField(c).alias(c) for c in new.columns])
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)
