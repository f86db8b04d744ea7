"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where that is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or f"file://{tempfile.gettempdir()}/tidemark-scratch"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in a folder for each value of ``by`` where given.

    Later plans start from the files, so a lost executor costs a re-read and not the whole
    lineage; unlike a cached table nothing depends on an executor's own disk.
    """
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out if by is None else out.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once no plan that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/").startswith(scratch_dir(spark).removeprefix("file:").strip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
