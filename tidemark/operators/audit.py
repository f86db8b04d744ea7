"""Group fairness: counts and rates by protected attribute, disparities, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.evaluate import cutoffs

GROUP = ["model_id", "parameter", "attribute_name"]
RATES = ("ppr", "pprev", "precision", "fdr", "for", "fpr", "fnr", "tpr", "tnr", "npv")


def group_crosstab(ranked: DataFrame, attributes: DataFrame, names: Sequence[str], thresholds: DataFrame) -> DataFrame:
    """Counts per model, threshold, attribute and value. Rows without a label are left out after the
    cutoff; a missing attribute is a group of its own, ``None``."""
    sizes = ranked.groupBy("model_id").agg(F.count("*").alias("n"))
    at = cutoffs(sizes, thresholds).select("model_id", "cutoff", F.concat_ws("_", F.col("value").cast("string"), "unit").alias("parameter"))
    # A row is above all cutoffs of its model from its own place among them on: rows are counted by place, once, not by threshold.
    places = at.groupBy("model_id").agg(F.array_sort(F.collect_set("cutoff")).alias("_cutoffs"))
    rows = ranked.filter("label is not null").join(F.broadcast(places), "model_id")  # models by a config's thresholds
    rows = rows.withColumn("_place", F.when(F.col("rank_abs_no_ties").isNotNull(), F.size(F.filter("_cutoffs", lambda c: c < F.col("rank_abs_no_ties")))))
    joined = rows.join(attributes.select("entity_id", "as_of_date", *[F.coalesce(F.col(n).cast("string"), F.lit("None")).alias(n) for n in names]), ["entity_id", "as_of_date"])
    tall = joined.unpivot(["model_id", "_place", "_cutoffs", "label"], list(names), "attribute_name", "attribute_value")
    by_place = tall.groupBy("model_id", "_place", "_cutoffs", "attribute_name", "attribute_value").agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") != 1).alias("_neg"))
    spread = by_place.join(at, "model_id").withColumn("_above", F.col("_place") < F.array_position("_cutoffs", F.col("cutoff")))
    pos, neg, p = F.col("_pos"), F.col("_neg"), F.col("_above")

    def total(n: Column, where: Column | None = None) -> Column:
        return F.sum(n if where is None else F.when(where, n).otherwise(0))

    counts = spread.groupBy(*GROUP, "attribute_value").agg(
        total(pos + neg).alias("group_size"), total(pos).alias("group_label_pos"), total(neg).alias("group_label_neg"),
        total(pos + neg, p).alias("pp"), total(pos + neg, ~p).alias("pn"), total(pos, p).alias("tp"), total(neg, p).alias("fp"), total(neg, ~p).alias("tn"), total(pos, ~p).alias("fn"),
    )
    w = W.partitionBy(*GROUP)  # the groups of one attribute
    return counts.withColumns({"total_entities": F.sum("group_size").over(w), "k": F.sum("pp").over(w)})


def group_rates(ct: DataFrame) -> DataFrame:
    def div(a: str, b: Column) -> Column:
        return F.try_divide(F.col(a), b)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return ct.withColumns({
        "prev": div("group_label_pos", F.col("group_size")), "ppr": div("pp", F.col("k")), "pprev": div("pp", F.col("group_size")),
        "tpr": div("tp", tp + fn), "tnr": div("tn", tn + fp), "for": div("fn", F.col("pn")), "fdr": div("fp", F.col("pp")), "fpr": div("fp", fp + tn), "fnr": div("fn", fn + tp),
        "npv": div("tn", F.col("pn")), "precision": div("tp", F.col("pp")), "group_size_pct": div("group_size", F.col("total_entities")),
    })


def disparity(rates: DataFrame, method: str = "majority", refs: dict[str, str] | None = None) -> DataFrame:
    """Each rate over that of a reference group: given (``predefined``), the largest (``majority``), or
    for each rate the group with the least (``min``). Ties go to the first value in order."""
    if method == "min":
        w = W.partitionBy(*GROUP)
        pick = {f"{r}_disparity": F.try_divide(F.col(r), F.min(r).over(w)) for r in RATES}
        ref = {f"{r}_ref_group_value": F.min(F.struct(F.col(r).isNull(), F.col(r), "attribute_value")).over(w)["attribute_value"] for r in RATES}
        return rates.withColumns(pick | ref)
    if method == "majority":
        best = rates.groupBy(*GROUP).agg(F.min(F.struct(-F.col("group_size"), "attribute_value"))["attribute_value"].alias("ref_group_value"))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in (refs or {}).items() for x in kv])
        best = rates.select(*GROUP).distinct().withColumn("ref_group_value", F.element_at(pairs, F.col("attribute_name")))
    base = rates.select(*GROUP, F.col("attribute_value").alias("ref_group_value"), *[F.col(r).alias(f"_{r}") for r in RATES])
    joined = rates.join(best, GROUP).join(base, [*GROUP, "ref_group_value"], "left")
    return joined.withColumns({f"{r}_disparity": F.try_divide(F.col(r), F.col(f"_{r}")) for r in RATES}).drop(*[f"_{r}" for r in RATES])


def parity(disp: DataFrame, tau: float = 0.8) -> DataFrame:
    """Whether each disparity lies in [tau, 1/tau], and the combined flags."""
    fair = {f"{r}_parity": F.col(f"{r}_disparity").between(tau, 1 / tau) for r in RATES}
    out = disp.withColumns(fair)
    return out.withColumns({
        "statistical_parity": F.col("ppr_parity"), "impact_parity": F.col("pprev_parity"),
        "type_i_parity": F.col("fdr_parity") & F.col("fpr_parity"), "type_ii_parity": F.col("for_parity") & F.col("fnr_parity"),
        "equalized_odds": F.col("fpr_parity") & F.col("tpr_parity"),
        "unsupervised_fairness": F.col("ppr_parity") | F.col("pprev_parity"),
    }).withColumn("supervised_fairness", F.col("type_i_parity") & F.col("type_ii_parity"))
