"""Learned models as tables: coefficients and tree nodes by model, fitted side by side, scored in one pass."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.matrix import KEYS
from tidemark.operators.score import spread

#: How a model's sums become the probability of class 1.
LINKS = ("logit", "mean", "margin")
#: A row is a coefficient (``tree`` -1; without a feature it is the intercept), a node of a tree, or what a feature
#: weighs in the model (``tree`` -2): its odds ratio, or its share of what the splits of the trees gain.
TABLE = "model_id long, link string, tree int, weight double, node int, feature string, threshold double, left int, right int, value double"
KINDS = ("logistic", "tree", "forest", "boosted")


@dataclass(frozen=True)
class Fit:
    """A model to be fitted: on the training rows of its split, from its columns."""

    model_id: int
    split: int
    kind: str
    params: dict
    columns: tuple[str, ...]


def training_faults(train: DataFrame, fits: Sequence[Fit]) -> dict[int, str]:
    """Models that can't be fitted, and why: no rows, or rows of one class only. Nulls in their features are an error.

    One aggregation over all splits.
    """
    columns = sorted({c for f in fits for c in f.columns})
    counts = train.groupBy("split").agg(F.count("*").alias("_n"), F.count("label").alias("_y"), F.sum("label").alias("_p"), *[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`"))).alias(f"_null{i}") for i, c in enumerate(columns)])
    by = {r.split: r for r in counts.collect()}  # a row per split
    out, nulls = {}, set()
    for f in fits:
        r = by.get(f.split)
        if r is None or not r._y:
            out[f.model_id] = "no rows to train on"
        elif f.kind in KINDS and r._p in (0, r._y):
            out[f.model_id] = "one class only"
        elif f.kind in KINDS:
            nulls |= {c for i, c in enumerate(columns) if c in f.columns and r[f"_null{i}"]}
    if nulls:
        raise ValueError(f"features with nulls to train on: {', '.join(sorted(nulls))}")
    return out


def _tree(model_id: int, link: str, tree: int, weight: float, root, columns: Sequence[str]) -> list[tuple]:
    """The nodes of one tree, numbered from 0."""
    rows: list[tuple] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append(())
        if node.subtreeDepth():
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            rows[at] = (model_id, link, tree, weight, at, columns[split.featureIndex()], float(split.threshold()), left, right, None)
        else:
            stats = list(node.impurityStats().stats()) if link == "mean" else None
            value = float(node.prediction()) if stats is None else float((stats[1] if len(stats) > 1 else 0.0) / sum(stats))
            rows[at] = (model_id, link, tree, weight, at, None, None, None, None, value)
        return at

    walk(root)
    return rows


def fit_models(train: DataFrame, fits: Sequence[Fit], at_once: int = 4) -> DataFrame:
    """The tables of all models. Fits run on the cluster, ``at_once`` side by side; ``train`` should be a written table
    with ``split`` and ``label``, of which each reads its split and columns."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kinds = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosted": GBTClassifier, "logistic": LogisticRegression}
    sizes = {r.split: r["count"] for r in train.groupBy("split").count().collect()}  # a row per split

    def fit(f: Fit) -> list[tuple]:
        rows = train.filter((F.col("split") == f.split) & F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(f.columns)])
        rows = spread(rows, sizes.get(f.split, 0))
        data = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(f.columns))], outputCol="_features", handleInvalid="error").transform(rows)
        model = kinds[f.kind](featuresCol="_features", labelCol="label", **f.params).fit(data)
        if f.kind == "logistic":
            weights = [(c, float(w)) for c, w in zip(f.columns, model.coefficients.toArray(), strict=True)]
            odds = [(f.model_id, "logit", -2, 1.0, i, c, None, None, None, math.exp(min(w, 700.0))) for i, (c, w) in enumerate(weights)]
            return odds + [(f.model_id, "logit", -1, 1.0, i, c, None, None, None, w) for i, (c, w) in enumerate([*weights, (None, float(model.intercept))])]
        link = "margin" if f.kind == "boosted" else "mean"
        gains = [(f.model_id, link, -2, 1.0, i, c, None, None, None, float(g)) for i, (c, g) in enumerate(zip(f.columns, model.featureImportances.toArray(), strict=True))]
        if f.kind == "tree":
            return gains + _tree(f.model_id, "mean", 0, 1.0, model._call_java("rootNode"), f.columns)
        return gains + [r for t, (tree, w) in enumerate(zip(model.trees, model.treeWeights, strict=True)) for r in _tree(f.model_id, link, t, float(w), tree._call_java("rootNode"), f.columns)]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for part in pool.map(fit, fits) for r in part]
    return train.sparkSession.createDataFrame(rows, TABLE)


def importances(tables: DataFrame) -> DataFrame:
    """``model_id, feature, feature_importance`` of the models."""
    return tables.filter("tree = -2").select("model_id", "feature", F.col("value").alias("feature_importance"))


@dataclass(frozen=True)
class _Model:
    model_id: int
    split: int
    link: str
    used: np.ndarray  # features that a row must have
    coefficients: np.ndarray | None
    intercept: float
    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for rows of features; NaN where one that it uses is missing."""
        if self.link == "logit":
            out = 1 / (1 + np.exp(-np.clip(x[:, self.used] @ self.coefficients + self.intercept, -700, 700)))
        else:
            total, rows = np.zeros(len(x)), np.arange(len(x))
            for weight, feature, threshold, left, right, value in self.trees:
                at = np.zeros(len(x), np.int64)
                while (inner := feature[at] >= 0).any():
                    low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(low, left[at], right[at]), at)
                total += weight * value[at]
            out = total / sum(t[0] for t in self.trees) if self.link == "mean" else 1 / (1 + np.exp(-2 * np.clip(total, -350, 350)))
        return np.where(np.isnan(x[:, self.used]).any(axis=1), np.nan, out)


def _models(tables: DataFrame, fits: Sequence[Fit], columns: Sequence[str]) -> list[_Model]:
    """Models from their rows, which a config bounds: models by trees by nodes."""
    place, rows, out = {c: i for i, c in enumerate(columns)}, defaultdict(list), []
    for r in tables.filter("tree > -2").collect():
        rows[r.model_id].append(r)
    for f in fits:
        own = rows.get(f.model_id)
        if not own:
            continue
        used = np.array([place[c] for c in f.columns], np.int64)
        if own[0].link == "logit":
            by = {r.feature: r.value for r in own}
            out.append(_Model(f.model_id, f.split, "logit", used, np.array([by[c] for c in f.columns]), by[None], []))
            continue
        trees: dict[int, list] = defaultdict(list)
        for r in own:
            trees[r.tree].append(r)
        made = []
        for nodes in trees.values():
            nodes.sort(key=lambda r: r.node)
            number = lambda get, empty: np.array([empty if get(r) is None else get(r) for r in nodes])  # noqa: B023, E731
            made.append((nodes[0].weight, number(lambda r: place[r.feature] if r.feature else None, -1), number(lambda r: r.threshold, 0.0), number(lambda r: r.left, 0), number(lambda r: r.right, 0), number(lambda r: r.value, 0.0)))
        out.append(_Model(f.model_id, f.split, own[0].link, used, None, 0.0, made))
    return out


def score_models(matrix: DataFrame, tables: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """``model_id``, the keys, ``score`` and ``label``: each row by all models of its split, in one scan of the matrix.

    A row that lacks a feature of a model has a null score by it. Models without a table give no rows.
    """
    spark: SparkSession = matrix.sparkSession
    columns = sorted({c for f in fits for c in f.columns})
    shared = spark.sparkContext.broadcast(_models(tables, fits, columns))  # bounded by a config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]) if columns else np.zeros((batch.num_rows, 0))
            split = batch.column("split").to_numpy(zero_copy_only=False)
            for model in shared.value:
                at = np.flatnonzero(split == model.split)
                if len(at):
                    own = batch.take(pa.array(at))
                    score = pa.array(model.score(x[at]), pa.float64(), from_pandas=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model.model_id)), *(own.column(k) for k in KEYS), score, own.column("label")], names=["model_id", *KEYS, "score", "label"])

    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    rows = matrix.select("split", *KEYS, "label", *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(run, f"model_id long, {KEYS[0]} {kinds[KEYS[0]]}, {KEYS[1]} {kinds[KEYS[1]]}, score double, label {kinds['label']}")
