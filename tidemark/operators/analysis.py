"""Post-modeling analysis: crosstabs, error analysis, list overlap, curves and histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.order import running_totals
from tidemark.functions.ttail import t_p_value
from tidemark.operators.evaluate import score_groups
from tidemark.operators.segments import merge_moments
from tidemark.sources.scratch import cut

KEYS = ["entity_id", "as_of_date"]


#: Cells of a task's tables before it hands them on: groups of rows by features.
CELLS = 1_000_000


#: Stands for a null model in arrays.
NO_MODEL = -(2**63)


def _rows_by_place(own: pa.ListArray) -> Iterator[tuple[tuple, np.ndarray]]:
    """For each model and place of a batch, ``(model_id, *places)``, its rows in order."""
    row, each = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)), own.flatten()
    if not len(each):
        return
    model = pc.fill_null(pc.struct_field(each, "model_id"), NO_MODEL).to_numpy(zero_copy_only=False)
    places = pc.list_flatten(pc.struct_field(each, "places")).to_numpy(zero_copy_only=False).reshape(len(each), -1)
    keys, place = np.unique(np.column_stack([model, places.astype(np.int64)]), axis=0, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(place.ravel(), minlength=len(keys)))
    for key, rows in zip(keys.tolist(), np.split(row[order], ends[:-1]), strict=True):
        yield (None if key[0] == NO_MODEL else key[0], *key[1:]), rows


def _feature_moments(n_features: int):
    """A task's numbers, means, squared deviations and positive values of all features, by model and place.

    Rows come with a list of their models and places; each is read once into arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def emit() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            whole = lambda k: pa.array([v[k].astype("int64").tolist() for v in values], pa.list_(pa.int64()))
            real = lambda k: pa.array([v[k].tolist() for v in values], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int32())), whole(0), real(1), real(2), whole(3)], names=["model_id", "_places", "n", "m", "q", "u"])

        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n_features)])
            for key, rows in _rows_by_place(batch.column("_models")):
                part = x[rows]
                there = ~np.isnan(part)
                n = there.sum(axis=0)
                mean = np.where(there, part, 0.0).sum(axis=0) / np.maximum(n, 1)
                q = (np.where(there, part - mean, 0.0) ** 2).sum(axis=0)
                u = (np.where(there, part, 0.0) > 0).sum(axis=0)
                old = held.get(key)
                if old is not None:
                    total = old[0] + n
                    share, d = n / np.maximum(total, 1), mean - old[1]
                    n, mean, q, u = total, old[1] + d * share, old[2] + q + d * d * old[0] * share, old[3] + u
                held[key] = [n, mean, q, u]
            if len(held) * n_features > CELLS:
                yield emit()
                held.clear()
        yield emit()

    return run


def crosstabs(pred: DataFrame, matrix: DataFrame, features: Sequence[str], thresholds: Sequence[tuple[str, float]]) -> DataFrame:
    """Predicted positives against the rest, per model, threshold (rank column, at most) and feature.

    A row's place among the cutoffs says on which side of each it is, so rows are counted once, by place, and
    spread over thresholds afterwards. Each matrix row meets the places it has by all models at once; tasks keep moments of
    all features as arrays, so thousands of features are no thousands of expressions. Null and NaN features
    count nowhere; rows without the rank are on neither side.
    """
    columns = list(dict.fromkeys(c for c, _ in thresholds))
    cutoffs = {c: sorted({float(k) for own, k in thresholds if own == c}) for c in columns}
    place = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cutoffs[c])), lambda k: k < F.col(c))))
    placed = pred.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("model_id").cast("long").alias("model_id"), F.array(*map(place, columns)).alias("places"))).alias("_models"))
    rows = placed.join(matrix.select(*KEYS, *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]), KEYS).drop(*KEYS)
    states = rows.mapInArrow(_feature_moments(len(features)), "model_id long, _places array<int>, n array<long>, m array<double>, q array<double>, u array<long>")
    each = states.select("model_id", "_places", F.posexplode(F.arrays_zip("n", "m", "q", "u")).alias("_i", "_s")).filter("_s.n > 0")
    # A state for each task.
    moments = each.groupBy("model_id", "_places", "_i").agg(merge_moments(F.struct("_s.n", "_s.m", "_s.q")).alias("_s"), F.sum("_s.u").alias("_u"))
    table = F.array(*[F.struct(F.lit(c).alias("threshold_type"), F.lit(float(k)).alias("threshold"), F.lit(columns.index(c)).alias("_c"), F.lit(cutoffs[c].index(float(k))).alias("_k")) for c, k in thresholds])
    own = F.get("_places", F.col("_t._c"))
    spread = moments.withColumn("_t", F.explode(table)).withColumn("_side", F.when(own >= 0, own <= F.col("_t._k"))).filter("_side is not null")

    def side(inside: Column, name: str) -> list[Column]:
        s = merge_moments(F.when(inside, F.col("_s")))
        n = s["n"]
        return [n.alias(f"count_{name}"), F.when(n > 0, s["m"]).alias(f"mean_{name}"), F.when(n > 1, F.sqrt(s["q"] / (n - 1))).alias(f"std_{name}"), F.coalesce(F.sum(F.when(inside, F.col("_u"))), F.lit(0)).alias(f"support_{name}")]

    sums = spread.groupBy("model_id", "_t.threshold_type", "_t.threshold", "_i").agg(*side(F.col("_side"), "pos"), *side(~F.col("_side"), "neg"))
    names = F.split(F.lit("\x1f".join(features)), "\x1f")
    # Features without any value have a row too.
    models = pred.select(F.col("model_id").cast("long").alias("model_id")).distinct()
    all_rows = models.withColumn("_t", F.explode(table)).select("model_id", "_t.threshold_type", "_t.threshold", F.posexplode(names).alias("_i", "feature"))
    long = all_rows.join(sums, ["model_id", "threshold_type", "threshold", "_i"], "left").drop("_i")
    long = long.withColumns({f"{k}_{s}": F.coalesce(F.col(f"{k}_{s}"), F.lit(0)) for k in ("count", "support") for s in ("pos", "neg")})
    ratio = F.try_divide(F.col("mean_pos"), F.col("mean_neg"))
    return long.withColumns({
        "ratio": ratio, "max_ratio": F.greatest(ratio, F.try_divide(F.lit(1.0), ratio)),
        "support_pct_pos": F.round(F.try_divide(F.col("support_pos"), F.col("count_pos")), 3), "support_pct_neg": F.round(F.try_divide(F.col("support_neg"), F.col("count_neg")), 3),
    })


def crosstab_ttest(ct: DataFrame) -> DataFrame:
    """Welch's T and its two-sided p-value for each row of ``crosstabs``."""
    vp, vn = F.pow("std_pos", 2) / F.col("count_pos"), F.pow("std_neg", 2) / F.col("count_neg")
    t = F.try_divide(F.col("mean_pos") - F.col("mean_neg"), F.sqrt(vp + vn))
    df = F.try_divide(F.pow(vp + vn, 2), F.pow(vp, 2) / (F.col("count_pos") - 1) + F.pow(vn, 2) / (F.col("count_neg") - 1))
    ok = (F.col("count_pos") > 1) & (F.col("count_neg") > 1)
    return ct.withColumns({"ttest_t": F.when(ok, t), "_df": F.when(ok, df)}).withColumn("ttest_p", t_p_value(F.col("ttest_t"), F.col("_df"))).drop("_df")


def dummify(df: DataFrame, cols: Sequence[str], most: int = 200) -> DataFrame:
    """Drops columns without any value and turns text columns into 0/1 columns, one for null too."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    keep = [c for c in df.columns if counts[c]]
    out = []
    for c in keep:
        if c not in cols:
            out.append(F.col(f"`{c}`"))
            continue
        values = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        out += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values] + [F.col(c).isNull().cast("int").alias(f"{c}_nan")]
    return df.select(*out)


def scope(pred: DataFrame, models: DataFrame | None = None, dates: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Predictions of the given models, dates and entities."""
    for other, key in ((models, "model_id"), (dates, "as_of_date"), (entities, "entity_id")):
        if other is not None:
            pred = pred.join(other.select(key), key, "left_semi")
    return pred


def error_labels(ranked: DataFrame, k: float, rank_col: str = "rank_abs_no_ties") -> DataFrame:
    """Predicted class at ``k``, the kind of each labelled row, and three 0/1 targets of errors."""
    p = (F.col(rank_col) <= k).cast("int")
    rows = ranked.filter("label is not null").withColumn("predicted", p)
    kind = F.when((F.col("predicted") == 1) & (F.col("label") == 1), "TP").when(F.col("predicted") == 1, "FP").when(F.col("label") == 1, "FN").otherwise("TN")
    out = rows.withColumn("kind", kind)
    return out.withColumns({"error": F.col("kind").isin("FP", "FN").cast("int"), "error_fp": (F.col("kind") == "FP").cast("int"), "error_fn": (F.col("kind") == "FN").cast("int")})


def error_trees(rows: DataFrame, features: Sequence[str], depths: Sequence[int] = (2, 3)) -> DataFrame:
    """A decision tree for each model, kind of error and depth: ``model_id, target, depth, feature,
    importance``. False positives are told from true positives, false negatives from true negatives.
    Models are a list of a config's length; their fits overlap. A kind that a model has no rows of has no tree.

    Rows are written once, by model: a fit goes several times over those of its model, and over no others."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut(rows.select("model_id", "predicted", "error", "error_fp", "error_fn", *[F.col(f"`{f}`") for f in features]), "errors", "model_id")
    ready = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(rows)
    slices = {"error": ready, "error_fp": ready.filter("predicted = 1"), "error_fn": ready.filter("predicted = 0")}
    counts = rows.groupBy("model_id").agg(F.count("*").alias("error"), F.sum("predicted").alias("error_fp"), F.sum(1 - F.col("predicted")).alias("error_fn")).collect()
    jobs = [(r.model_id, target, depth) for r in counts for target in slices if r[target] for depth in depths]

    def fit(job: tuple) -> list[tuple]:
        model_id, target, depth = job
        tree = DecisionTreeClassifier(featuresCol="_features", labelCol=target, maxDepth=depth, seed=0).fit(slices[target].filter(F.col("model_id") == model_id))
        return [(*job, f, float(v)) for f, v in zip(features, tree.featureImportances.toArray(), strict=True)]

    with ThreadPoolExecutor(4) as pool:
        out = [row for part in pool.map(fit, jobs) for row in part]
    return rows.sparkSession.createDataFrame(out, "model_id long, target string, depth int, feature string, importance double")


def _pairwise(rows: DataFrame, key: Sequence[str], rank_col: str) -> DataFrame:
    """Overlap of each pair of models' lists; lists are short, so only listed rows are joined."""
    a = rows.select(F.col("model_id").alias("model_1"), *key, F.col(rank_col).cast("double").alias("r1"))
    b = rows.select(F.col("model_id").alias("model_2"), *key, F.col(rank_col).cast("double").alias("r2"))
    both = a.join(b, list(key)).filter("model_1 < model_2").groupBy("model_1", "model_2").agg(F.count("*").alias("n_both"), F.corr("r1", "r2").alias("rank_corr"))
    sizes = rows.groupBy("model_id").agg(F.count("*").alias("n"))
    pairs = sizes.select(F.col("model_id").alias("model_1"), F.col("n").alias("n1")).join(sizes.select(F.col("model_id").alias("model_2"), F.col("n").alias("n2")), F.col("model_1") < F.col("model_2"))
    out = pairs.join(both, ["model_1", "model_2"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.select("model_1", "model_2", "n_both", (F.col("n_both") / (F.col("n1") + F.col("n2") - F.col("n_both"))).alias("jaccard"), (F.col("n_both") / F.least("n1", "n2")).alias("overlap"), "rank_corr")


def pairwise_lists(ranked: DataFrame, k: float, rank_col: str = "rank_abs_no_ties") -> DataFrame:
    return _pairwise(ranked.filter(F.col(rank_col) <= k), KEYS, rank_col)


def pairwise_features(ranked_importances: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("model_id").orderBy(F.col("feature_importance").desc(), "feature")
    return _pairwise(ranked_importances.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n), ["feature"], "_nth")


def pr_k_curve(ranked: DataFrame, step: int = 1, rank_col: str = "rank_abs_no_ties") -> DataFrame:
    """Precision and recall of labelled rows in the first k % of the list, for every ``step`` percent."""
    labelled = ranked.filter("label is not null").select("model_id", "label", rank_col)
    rows = running_totals(labelled, ["model_id"], [F.col(rank_col)], {"cutoff": F.lit(1).cast("long"), "tp": F.col("label")})
    total = rows.groupBy("model_id").agg(F.max("cutoff").alias("n"), F.max("tp").alias("p"))
    at = total.withColumn("k_pct", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step)))).withColumn("cutoff", F.bround(F.col("k_pct") * F.col("n") / 100.0, 0).cast("long"))
    got = at.join(rows, ["model_id", "cutoff"], "left")
    return got.select("model_id", "k_pct", F.coalesce(F.try_divide(F.col("tp"), F.col("cutoff")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0)).alias("recall"))


def score_histogram(pred: DataFrame, nbins: int = 10, by_label: bool = False) -> DataFrame:
    """Counts by equal bins between a model's least and greatest score, the last bin closed; by label
    each label has a range of its own."""
    keys = ["model_id", "label"] if by_label else ["model_id"]
    rows = pred.filter("label is not null") if by_label else pred
    ends = rows.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean_score"))
    width = (F.col("hi") - F.col("lo")) / nbins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(nbins - 1))).cast("int")
    return rows.join(ends, keys).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.first("mean_score").alias("mean_score"), F.first(F.col("lo")).alias("lo"), F.first(F.col("hi")).alias("hi"))


def calibration(pred: DataFrame, nbins: int = 10) -> DataFrame:
    """Mean score and share of positives per equal bin of [0, 1]; edges belong to the lower bin."""
    place = F.greatest(F.lit(0), F.least(F.lit(nbins - 1), F.ceil(F.col("score") * nbins).cast("int") - 1))
    return pred.filter("label is not null").groupBy("model_id", place.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("pct_positive"))


def threshold_curve(evals: DataFrame, metric: str, unit: str = "pct") -> DataFrame:
    """A stored metric by list size: the number in front of ``_pct`` or ``_abs`` in the parameter."""
    parts = F.split("parameter", "_")
    return evals.filter((F.col("metric") == metric) & (parts[1] == unit)).select("model_id", parts[0].cast("double").alias("list_size"), F.col("stochastic_value").alias("value"))


def disparity_vs_performance(evals: DataFrame, audit: DataFrame, metric: str, parameter: str, attribute: str, value: str, disparity: str, invert: bool = False) -> DataFrame:
    """Each model's metric next to the disparity of one group, or its inverse."""
    d = F.col(f"{disparity}_disparity")
    own = audit.filter((F.col("attribute_name") == attribute) & (F.col("attribute_value") == value)).select("model_id", (F.try_divide(F.lit(1.0), d) if invert else d).alias("disparity"))
    perf = evals.filter((F.col("metric") == metric) & (F.col("parameter") == parameter)).select("model_id", F.col("stochastic_value").alias("performance"))
    return perf.join(own, "model_id", "left")


def roc_points(pred: DataFrame) -> DataFrame:
    """At each distinct score, from the top: false and true positive rates and share of the list."""
    g = score_groups(pred.filter("label is not null"))
    all_of = g.groupBy("model_id").agg(F.sum("l").alias("_n"), F.sum("p").alias("_p"))
    m, p = F.col("l0") + F.col("l"), F.col("p0") + F.col("p")
    rates = [F.try_divide(m - p, F.col("_n") - F.col("_p")).alias("fpr"), F.try_divide(p, F.col("_p")).alias("tpr"), (m / F.col("_n")).alias("list_pct")]
    return g.join(all_of, "model_id").select("model_id", "score", *rates)  # a row per model
