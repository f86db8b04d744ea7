"""What an experiment has done: models by what they are made of, and stages that were written to the end.

A model keeps the id it got when its content was first seen. A stage of a model is committed once its rows are
written, with how many they are: it counts as done while that many are stored and it was done in the same
manner (tie rule, definitions). One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.selection import assign_model_groups

MODELS = "model_id long, model_hash string, split int, train_end_time date, feature_set string, model_type string, hyperparameters string, feature_list array<string>, model_config string, group_key string, model_group_id int"
COMMITS = "model_id long, stage string, manner string, n_rows long, turn long"
#: Model rows of a plan, before they have an id and a group.
PLANNED = ("model_hash", "split", "train_end_time", "feature_set", "model_type", "hyperparameters", "feature_list", "model_config")


def content_hash(*parts: object) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table of a store, without rows where nothing has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class Ledger:
    """``models`` and ``commits`` under a path; both are only added to, a few rows for each run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def models(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/models", MODELS)

    def commits(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/commits", COMMITS)

    def register(self, plan: Sequence[dict]) -> DataFrame:
        """The models of a plan with their ids and groups. New ones follow the known ones in the plan's order."""
        known = self.models()
        numbers = {r.model_hash: r.model_id for r in known.select("model_hash", "model_id").collect()}  # models, not rows
        new = [m for m in plan if m["model_hash"] not in numbers]
        if new:
            first = max(numbers.values(), default=0) + 1
            rows = self.spark.createDataFrame([(i, *[m[c] for c in PLANNED]) for i, m in enumerate(new, first)], "model_id long, model_hash string, split int, train_end_time date, feature_set string, model_type string, hyperparameters string, feature_list array<string>, model_config string")
            existing = known.select("group_key", "model_group_id").distinct() if numbers else None
            assign_model_groups(rows, existing).select(*StructType.fromDDL(MODELS).names).coalesce(1).write.mode("append").parquet(f"{self.path}/models")
        hashes = self.spark.createDataFrame([(m["model_hash"],) for m in plan], "model_hash string").distinct()
        return self.models().join(F.broadcast(hashes), "model_hash", "left_semi")  # a config's models

    def missing(self, models: DataFrame, stage: str, manner: str, rows: DataFrame) -> list[int]:
        """Models whose stage is not committed in this manner, or of whose ``rows`` others than committed are stored."""
        last = self.commits().filter(F.col("stage") == stage).groupBy("model_id").agg(F.max_by(F.struct("manner", "n_rows"), "turn").alias("_c"))
        counts = rows.groupBy("model_id").agg(F.count("*").alias("_n"))
        done = last.join(counts, "model_id", "left").filter((F.col("_c.manner") == manner) & (F.col("_c.n_rows") == F.coalesce("_n", F.lit(0))))
        return sorted(r.model_id for r in models.select("model_id").join(done, "model_id", "left_anti").collect())

    def commit(self, ids: Iterable[int], stage: str, manner: str, rows: DataFrame) -> None:
        """After the rows of these models are written; models without a row are done as well."""
        ids = list(ids)
        counts = {r.model_id: r.n for r in rows.filter(F.col("model_id").isin(ids)).groupBy("model_id").agg(F.count("*").alias("n")).collect()}
        turn = (self.commits().agg(F.max("turn")).first()[0] or 0) + 1
        self.spark.createDataFrame([(i, stage, manner, counts.get(i, 0), turn) for i in ids], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
