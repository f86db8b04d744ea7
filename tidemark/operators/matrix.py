"""Design matrices: row index, labels, feature tables, column sets, gates and summaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("entity_id", "as_of_date")


def feature_dictionary(tables: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> dict[str, list[str]]:
    return {name: [c for c in df.columns if c not in keys] for name, df in tables.items()}


def feature_groups(features: dict[str, list[str]], definition: dict[str, Sequence[str]]) -> dict[str, dict[str, list[str]]]:
    """Groups of columns: by ``tables``, ``prefix``, ``metric`` (suffix), ``interval`` or ``all``."""
    flat = [(t, c) for t, cols in features.items() for c in cols]
    tests = {
        "tables": lambda v, t, c: t == v,
        "prefix": lambda v, t, c: c.startswith(f"{v}_"),
        "metric": lambda v, t, c: c.removesuffix("_imp").endswith(f"_{v}"),
        "interval": lambda v, t, c: f"_{v}_" in c,
        "all": lambda v, t, c: True,
    }
    out = {}
    for kind, values in definition.items():
        for v in values:
            picked: dict[str, list[str]] = {}
            for t, c in flat:
                if tests[kind](v, t, c):
                    picked.setdefault(t, []).append(c)
            out[f"{kind}: {v}"] = picked
    return out


def mix_groups(groups: dict[str, dict], strategies: Sequence[str]) -> list[list[str]]:
    """Sets of group names: ``all``, ``leave-one-out``, ``leave-one-in``, ``all-combinations``; each set once."""
    names = list(groups)
    makers = {
        "all": lambda: [names],
        "leave-one-out": lambda: [[n for n in names if n != x] for x in names] if len(names) > 1 else [],
        "leave-one-in": lambda: [[x] for x in names],
        "all-combinations": lambda: [list(c) for k in range(1, len(names) + 1) for c in combinations(names, k)],
    }
    out: list[list[str]] = []
    for s in strategies:
        out += [m for m in makers[s]() if m not in out]
    return out


def matrix_index(cohort: DataFrame, labels: DataFrame, dates: Sequence, kind: str, fill: int | None = None, timespan: str | None = None, name: str | None = None) -> DataFrame:
    """Rows of a matrix: active cohort rows on the dates; for training only those with a label,
    unless missing labels are filled."""
    rows = cohort.filter(F.col("active") & F.col("as_of_date").isin(list(dates))).select(*KEYS)
    if kind != "train" or fill is not None:
        return rows.distinct()
    return rows.distinct().join(_labels(labels, timespan, name).filter("label is not null"), list(KEYS), "left_semi")


def _labels(labels: DataFrame, timespan: str | None, name: str | None) -> DataFrame:
    out = labels
    if timespan:
        out = out.filter(F.col("label_timespan") == timespan)
    if name:
        out = out.filter(F.col("label_name") == name)
    return out.select(*KEYS, "label")


def attach_labels(index: DataFrame, labels: DataFrame, fill: int | None = None, timespan: str | None = None, name: str | None = None) -> DataFrame:
    out = index.join(_labels(labels, timespan, name), list(KEYS), "left")
    return out if fill is None else out.withColumn("label", F.coalesce("label", F.lit(fill)))


def downcast(df: DataFrame, keep: Sequence[str] = (*KEYS, "label")) -> DataFrame:
    """Features as 32-bit floats."""
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").cast("float").alias(c) for c in df.columns])


def build_matrix(index: DataFrame, features: Sequence[DataFrame], labels: DataFrame | None, fill: int | None = None, timespan: str | None = None, name: str | None = None) -> DataFrame:
    """Index, every feature table by left join on the keys, features as floats, the label last. Without
    labels (scoring forward) the label is 0."""
    out = index
    for f in features:
        out = out.join(f, list(KEYS), "left")
    out = out.withColumn("label", F.lit(0)) if labels is None else attach_labels(out, labels, fill, timespan, name)
    return downcast(out)


def key_faults(parts: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that are not in each part exactly once: ``keys, n_parts, n_rows``."""
    rows = None
    for i, p in enumerate(parts):
        one = p.select(*keys, F.lit(i).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys).agg(F.count_distinct("part").alias("n_parts"), F.count("*").alias("n_rows")).filter((F.col("n_parts") < len(parts)) | (F.col("n_rows") > len(parts)))


def assert_same_keys(parts: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> None:
    if not key_faults(parts, keys).isEmpty():
        raise ValueError("matrix parts have different keys")


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (*KEYS, "label")) -> DataFrame:
    """Features in the order of training; extra or missing ones are an error."""
    own = [c for c in df.columns if c not in keep]
    if faults := set(own) ^ set(columns):
        raise ValueError(f"columns differ: {', '.join(sorted(faults))}")
    return df.select(*[c for c in keep if c in df.columns and c != "label"], *[F.col(f"`{c}`") for c in columns], *[c for c in ("label",) if c in df.columns])


def matrix_uuid(metadata: dict) -> str:
    """Digest of the metadata as sorted JSON."""
    return hashlib.md5(json.dumps(metadata, sort_keys=True, default=str).encode()).hexdigest()


def matrix_summary(matrix: DataFrame, metadata: dict) -> DataFrame:
    """One row: id, rows, entities, dates, labelled rows and label rate."""
    return matrix.agg(
        F.lit(matrix_uuid(metadata)).alias("matrix_uuid"),
        F.count("*").alias("n_rows"),
        F.count_distinct("entity_id").alias("n_entities"),
        F.count_distinct("as_of_date").alias("n_dates"),
        F.count("label").alias("n_labelled"),
        F.avg("label").alias("label_rate"),
    )
