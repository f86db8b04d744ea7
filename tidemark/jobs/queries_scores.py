"""Queries over scores: scoring, ranks, evaluations, fairness audits, importances."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.jobs import pipelines
from tidemark.jobs.fixtures import EVENT_DATES, IMPORTANCES, MATRIX, PRED, Register, importances, matrix, predictions, rounded, table
from tidemark.operators import audit as A
from tidemark.operators import evaluate as V
from tidemark.operators import importance as N
from tidemark.operators import rank as R
from tidemark.operators import score as B
from tidemark.operators.splits import TemporalConfig
from tidemark.sources.scratch import cut, new_path

REGISTER = Register()


@REGISTER(f"WITH {MATRIX} SELECT entity_id, (quantity > 100 OR tax < 0.03)::INTEGER::BIGINT AS any_rule, (quantity > 100 AND tax < 0.03)::INTEGER::BIGINT AS every_rule FROM matrix")
def score_thresholds(spark, d):
    rules = ["quantity > 100", {"feature_name": "tax", "operator": "<", "threshold": 0.03}]
    either = B.score_thresholds(matrix(spark, d), rules, "or").withColumnRenamed("score", "any_rule")
    return rounded(B.score_thresholds(either, rules, "and").select("entity_id", "any_rule", F.col("score").alias("every_rule")))


@REGISTER(f"WITH {MATRIX} SELECT entity_id, round((rank() OVER (ORDER BY quantity) - 1) / count(*) OVER (), 8) AS score FROM matrix")
def score_percentile_rank(spark, d):
    return rounded(B.score_percentile_rank(matrix(spark, d), "quantity").select("entity_id", "score"), 8)


@REGISTER(f"WITH {MATRIX} SELECT entity_id, round((rank() OVER (ORDER BY tax DESC) - 1) / count(*) OVER (), 8) AS score FROM matrix")
def score_percentile_rank_low(spark, d):
    return rounded(B.score_percentile_rank(matrix(spark, d), "tax", low_value_high_score=True).select("entity_id", "score"), 8)


@REGISTER(f"WITH {MATRIX}, r AS (SELECT entity_id, dense_rank() OVER (ORDER BY lines, -quantity) - 1 AS r FROM matrix) SELECT entity_id, round(r / (SELECT nullif(max(r), 0) FROM r), 8) AS score FROM r")
def score_multi_rank(spark, d):
    return rounded(B.score_multi_rank(matrix(spark, d), [("lines", False), ("quantity", True)]).select("entity_id", "score"), 8)


_LINEAR = """caps AS (SELECT quantile_cont(quantity, 0.99) AS q, quantile_cont(tax, 0.99) AS t, quantile_cont(lines, 0.99) AS l FROM matrix)"""
_LINEAR_SCORE = "(least(quantity, q) / q * 0.5::DOUBLE + least(tax, t) / t * 0.3::DOUBLE + least(lines, l) / l * 0.2::DOUBLE)"


@REGISTER(f"WITH {MATRIX}, {_LINEAR} SELECT entity_id, round({_LINEAR_SCORE}, 6) AS score FROM matrix, caps")
def score_linear(spark, d):
    return rounded(B.score_linear(matrix(spark, d), ["quantity", "tax", "lines"], [5, 3, 2]).select("entity_id", "score"))


@REGISTER(f"""WITH {MATRIX}, s AS (SELECT min(quantity) AS a, max(quantity) AS b, min(lines) AS c, max(lines) AS e FROM matrix WHERE entity_id % 2 = 0)
SELECT entity_id, round(greatest(0, least(1, (quantity - a) / (b - a))), 6) AS quantity, round(greatest(0, least(1, (lines - c) / (e - c))), 6) AS lines FROM matrix, s WHERE entity_id % 2 = 1""")
def min_max_scaling(spark, d):
    m = matrix(spark, d).select("entity_id", "quantity", "lines")
    stats = B.fit_min_max(m.filter("entity_id % 2 = 0"), ["quantity", "lines"])
    return rounded(B.apply_min_max(m.filter("entity_id % 2 = 1"), stats, ["quantity", "lines"]))


@REGISTER(f"WITH {PRED} SELECT model_id, entity_id, round((SELECT avg(label) FROM pred WHERE model_id <= 3), 6) AS score FROM pred WHERE model_id > 3")
def score_prior(spark, d):
    p = predictions(spark, d)
    return rounded(B.score_prior(p.filter("model_id <= 3"), p.filter("model_id > 3").drop("score")).select("model_id", "entity_id", "score"))


def _labelled_matrix(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return matrix(spark, d).join(y, "entity_id")


def train_scaled_lr(spark, d):
    m = _labelled_matrix(spark, d)
    model = B.train_scaled_lr(m.filter("entity_id % 2 = 0"), ["quantity", "tax", "lines"], maxIter=10)
    return B.score(model, m.filter("entity_id % 2 = 1"))


def train_grid(spark, d):
    """Half of the orders train three models, which score the other half in one pass."""
    m = _labelled_matrix(spark, d)
    grid = {"tree": {"maxDepth": [2, 4]}, "forest": {"numTrees": [5], "maxDepth": [3], "seed": [1]}}
    fits = B.train_grid(m.filter("entity_id % 2 = 0"), ["quantity", "tax", "lines"], grid)
    names = F.array(*[F.lit(f"{kind} {params}") for kind, params, _ in fits])
    scored = B.score_grid([model for _, _, model in fits], m.filter("entity_id % 2 = 1"))
    return scored.select("model_id", F.get(names, F.col("model_id")).alias("model"), "entity_id", "score")


REGISTER.queries |= {"train_scaled_lr": train_scaled_lr, "train_grid": train_grid}

_ORDER = {"worst": "label ASC NULLS FIRST", "best": "label DESC NULLS LAST", "random": "md5(concat_ws('|', '7', entity_id, as_of_date))"}


def _ranks_sql(rule: str, by: str = "PARTITION BY model_id") -> str:
    return f"""SELECT model_id, entity_id, row_number() OVER ({by} ORDER BY score DESC, {_ORDER[rule]}, entity_id) AS rank_abs_no_ties, rank() OVER ({by} ORDER BY score DESC) AS rank_abs_with_ties,
  round(row_number() OVER ({by} ORDER BY score DESC, {_ORDER[rule]}, entity_id) / count(*) OVER ({by}), 6) AS rank_pct_no_ties,
  round(dense_rank() OVER ({by} ORDER BY score DESC) / (SELECT count(DISTINCT score) FROM pred q WHERE q.model_id = p.model_id), 6) AS rank_pct_with_ties FROM pred p"""


_RANKS = ["model_id", "entity_id", "rank_abs_no_ties", "rank_abs_with_ties", "rank_pct_no_ties", "rank_pct_with_ties"]


@REGISTER(f"WITH {PRED} {_ranks_sql('worst')}")
def rank_predictions_worst(spark, d):
    return rounded(R.rank_predictions(predictions(spark, d), "worst").select(_RANKS))


@REGISTER(f"WITH {PRED} {_ranks_sql('best')}")
def rank_predictions_best(spark, d):
    return rounded(R.rank_predictions(predictions(spark, d), "best").select(_RANKS))


@REGISTER(f"WITH {PRED} {_ranks_sql('random')}")
def rank_predictions_random(spark, d):
    return rounded(R.rank_predictions(predictions(spark, d), "random", seed=7).select(_RANKS))


@REGISTER(f"WITH {PRED} {_ranks_sql('worst')}")
def rank_distributed(spark, d):
    return rounded(R.rank_predictions(predictions(spark, d), "worst").select(_RANKS))


@REGISTER(f"WITH {PRED} {_ranks_sql('best')}")
def rank_small_models(spark, d):
    return rounded(R.rank_small_models(predictions(spark, d), "best").select(_RANKS))


@REGISTER(f"WITH {PRED}, r AS ({_ranks_sql('best')}) SELECT model_id, entity_id, rank_abs_no_ties FROM r WHERE rank_abs_no_ties <= 25")
def top_k(spark, d):
    return rounded(R.top_k(R.rank_predictions(predictions(spark, d), "best"), "rank_abs_no_ties", 25).select(_RANKS[:3]))


@REGISTER("""WITH p AS (SELECT DISTINCT l_linenumber::BIGINT AS model_id, l_shipdate::DATE AS as_of_date, l_returnflag FROM lineitem),
m AS (SELECT DISTINCT model_id FROM p), dd AS (SELECT DISTINCT as_of_date FROM p), done AS (SELECT model_id, as_of_date FROM p GROUP BY ALL HAVING NOT bool_or(l_returnflag = 'N'))
SELECT model_id, as_of_date FROM m, dd ANTI JOIN done USING (model_id, as_of_date)""".replace("FROM m, dd ANTI JOIN done USING (model_id, as_of_date)", "FROM (SELECT * FROM m, dd) ANTI JOIN done USING (model_id, as_of_date)"))
def missing_predictions(spark, d):
    """Models and ship dates where some row has no rank (here: flag N)."""
    p = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("model_id"), F.to_date("l_shipdate").alias("as_of_date"), F.when(F.col("l_returnflag") != "N", 1).alias("rank_abs_no_ties"))
    return R.missing_predictions(p.select("model_id").distinct(), p, p.select("as_of_date"))


@REGISTER(f"""WITH {PRED}, r AS (SELECT model_id, as_of_date, entity_id, score, CASE WHEN entity_id % 3 = 0 THEN row_number() OVER (PARTITION BY model_id ORDER BY score DESC, label ASC NULLS FIRST, entity_id) END AS ra FROM pred)
SELECT model_id, as_of_date, entity_id, score, coalesce(ra, row_number() OVER w) AS rank_abs, coalesce(ra * 100.0, ntile(100) OVER w)::DOUBLE AS rank_pct FROM r WINDOW w AS (PARTITION BY model_id, as_of_date ORDER BY score DESC, entity_id)""")
def fallback_ranks(spark, d):
    r = R.rank_predictions(predictions(spark, d), "worst")
    known = F.col("entity_id") % 3 == 0
    part = r.withColumns({"rank_abs_no_ties": F.when(known, F.col("rank_abs_no_ties")), "rank_pct_no_ties": F.when(known, F.col("rank_abs_no_ties").cast("double"))})
    return rounded(R.fallback_ranks(part))


GROUPS = [
    {"metrics": ["precision@", "recall@"], "thresholds": {"percentiles": [5.0, 10.0], "top_n": [100]}},
    {"metrics": ["fbeta@"], "parameters": [{"beta": 0.75}], "thresholds": {"top_n": [100]}},
    {"metrics": ["false positives@", "fpr@", "true negatives@"], "thresholds": {"percentiles": [10.0]}},
    {"metrics": ["accuracy", "f1"]},
]
DEFS = """defs AS (SELECT * FROM (VALUES
  ('precision@', 'pct', 5.0, 1.0, '5.0_pct'), ('precision@', 'pct', 10.0, 1.0, '10.0_pct'), ('precision@', 'abs', 100.0, 1.0, '100_abs'),
  ('recall@', 'pct', 5.0, 1.0, '5.0_pct'), ('recall@', 'pct', 10.0, 1.0, '10.0_pct'), ('recall@', 'abs', 100.0, 1.0, '100_abs'),
  ('fbeta@', 'abs', 100.0, 0.75, '0.75_beta/100_abs'), ('false positives@', 'pct', 10.0, 1.0, '10.0_pct'), ('fpr@', 'pct', 10.0, 1.0, '10.0_pct'), ('true negatives@', 'pct', 10.0, 1.0, '10.0_pct'),
  ('accuracy', 'all', 100.0, 1.0, ''), ('f1', 'all', 100.0, 1.0, '')) v(metric, unit, value, beta, parameter))"""


def _confusion_sql(name: str, order: str, source: str = "pred", extra: str = "") -> str:
    """Plain counting, threshold by threshold."""
    e = f", {extra}" if extra else ""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY model_id{e} ORDER BY score DESC, {order}, entity_id) AS rn, count(*) OVER (PARTITION BY model_id{e}) AS n FROM {source}),
{name} AS (SELECT model_id{e}, unit, value, count(*) FILTER (WHERE p AND label = 1) AS tp, count(*) FILTER (WHERE p AND label = 0) AS fp, count(*) FILTER (WHERE NOT p AND label = 1) AS fn, count(*) FILTER (WHERE NOT p AND label = 0) AS tn
FROM (SELECT r.*, t.*, rn <= CASE WHEN unit = 'abs' THEN value ELSE floor(n * value / 100) END AS p FROM {name}_r r, (SELECT DISTINCT unit, value FROM defs) t) WHERE label IS NOT NULL GROUP BY ALL)"""


_VALUE = """CASE metric WHEN 'precision@' THEN coalesce(tp / nullif(tp + fp, 0), 0) WHEN 'recall@' THEN coalesce(tp / nullif(tp + fn, 0), 0)
  WHEN 'fbeta@' THEN coalesce((1 + beta * beta) * tp / nullif((1 + beta * beta) * tp + beta * beta * fn + fp, 0), 0) WHEN 'f1' THEN coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0)
  WHEN 'accuracy' THEN coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) WHEN 'false positives@' THEN fp WHEN 'true negatives@' THEN tn WHEN 'fpr@' THEN fp / nullif(fp + tn, 0) END::DOUBLE"""


def _defs(spark):
    return V.metric_definitions(spark, GROUPS)


@REGISTER(f"WITH {PRED}, {DEFS} SELECT metric, unit, value::DOUBLE AS value, beta::DOUBLE AS beta, parameter, count(DISTINCT model_id) AS n_models FROM defs, pred GROUP BY ALL")
def metric_definitions(spark, d):
    """The config's metrics, and for how many models each is to be computed."""
    n = predictions(spark, d).agg(F.count_distinct("model_id").alias("n_models"))
    return _defs(spark).crossJoin(n)


@REGISTER(f"WITH {PRED}, {DEFS}, {_confusion_sql('c', 'label ASC NULLS FIRST')} SELECT model_id, unit, value::DOUBLE AS value, tp, fp, fn, tn FROM c")
def confusion_worst(spark, d):
    return V.confusion(predictions(spark, d), _defs(spark).select("unit", "value").distinct(), "worst").select("model_id", "unit", "value", "tp", "fp", "fn", "tn")


@REGISTER(f"WITH {PRED}, {DEFS}, {_confusion_sql('c', 'label DESC NULLS LAST')} SELECT model_id, metric, parameter, round({_VALUE}, 6) AS best_value FROM c JOIN defs USING (unit, value)")
def metrics_best(spark, d):
    conf = V.confusion(predictions(spark, d), _defs(spark).select("unit", "value").distinct(), "best")
    return rounded(V.metrics(conf, _defs(spark), "best_value").select("model_id", "metric", "parameter", "best_value"))


@REGISTER(f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, label ASC NULLS FIRST, entity_id) AS rn FROM pred)
SELECT model_id, entity_id, label::BIGINT AS label, (rn <= 50)::INTEGER::BIGINT AS predicted FROM r""")
def binarize(spark, d):
    at = spark.createDataFrame([("abs", 50.0)], "unit string, value double")
    return rounded(V.binarize(R.rank_predictions(predictions(spark, d), "worst"), at).select("model_id", "entity_id", "label", "predicted"))


@REGISTER(f"""WITH {PRED}, l AS (SELECT model_id, score, label FROM pred WHERE label IS NOT NULL), g AS (SELECT model_id, score, sum(label) AS p, sum(1 - label) AS q FROM l GROUP BY ALL),
u AS (SELECT a.model_id, sum(a.p * (coalesce((SELECT sum(q) FROM g b WHERE b.model_id = a.model_id AND b.score < a.score), 0) + a.q / 2)) AS u, sum(p) * sum(q) AS pq FROM g a GROUP BY 1)
SELECT model_id, round(u / nullif(pq, 0), 8) AS roc_auc FROM u""")
def roc_auc(spark, d):
    return rounded(V.roc_auc(predictions(spark, d)), 8)


@REGISTER(f"""WITH {PRED}, g AS (SELECT model_id, score, sum(label) AS p, count(*) AS m FROM pred WHERE label IS NOT NULL GROUP BY ALL),
c AS (SELECT model_id, p, sum(p) OVER w AS cp, sum(m) OVER w AS cm FROM g WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model_id, round(sum(p * cp / cm) / nullif(sum(p), 0), 8) AS average_precision FROM c GROUP BY 1""")
def average_precision(spark, d):
    return rounded(V.average_precision(predictions(spark, d)), 8)


_TRIALS_SQL = "tried AS (SELECT p.*, t AS trial FROM pred p, range(1, 31) r(t))"
_EVALUATE_SQL = f"""WITH {{pred}}, {DEFS}, {_TRIALS_SQL}, {_confusion_sql('w', 'label ASC NULLS FIRST')}, {_confusion_sql('b', 'label DESC NULLS LAST')}, {_confusion_sql('t', "md5(concat_ws('|', trial::VARCHAR, entity_id, as_of_date))", 'tried', 'trial')},
wv AS (SELECT model_id, metric, parameter, {_VALUE} AS worst_value, tp + fp AS above, tp + fn AS pos, tp + fp + tn + fn AS labeled FROM w JOIN defs USING (unit, value)),
bv AS (SELECT model_id, metric, parameter, {_VALUE} AS best_value FROM b JOIN defs USING (unit, value)),
tv AS (SELECT model_id, metric, parameter, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT model_id, metric, parameter, {_VALUE} AS v FROM t JOIN defs USING (unit, value)) GROUP BY ALL),
z AS (SELECT *, best_value IS NULL OR abs(best_value - worst_value) <= 0.01 * greatest(abs(best_value), abs(worst_value)) AS close FROM wv JOIN bv USING (model_id, metric, parameter) JOIN tv USING (model_id, metric, parameter))
SELECT model_id, metric, parameter, round(best_value, 6) AS best_value, round(worst_value, 6) AS worst_value, round(CASE WHEN close THEN worst_value ELSE m END, 6) AS stochastic_value,
  round(CASE WHEN close THEN 0 ELSE s END, 6) AS standard_deviation, CASE WHEN close THEN 0 ELSE 30 END::BIGINT AS num_sort_trials, labeled AS num_labeled_examples, above AS num_labeled_above_threshold, pos AS num_positive_labels FROM z"""


@REGISTER(_EVALUATE_SQL.format(pred=PRED))
def evaluate(spark, d):
    return rounded(V.evaluate(predictions(spark, d), _defs(spark)))


_SCORES_SQL = """g AS (SELECT model_id, score, sum(label) AS p, sum(1 - label) AS q, count(*) AS m FROM pred WHERE label IS NOT NULL GROUP BY ALL),
u AS (SELECT model_id, p, q, m, sum(q) OVER (PARTITION BY model_id ORDER BY score ROWS UNBOUNDED PRECEDING) - q / 2 AS below,
  sum(p) OVER w AS cp, sum(m) OVER w AS cm FROM g WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
v AS (SELECT model_id, sum(p * below) / nullif(sum(p) * sum(q), 0) AS auc, sum(p * cp / cm) / nullif(sum(p), 0) AS ap FROM u GROUP BY 1),
n AS (SELECT model_id, count(label) AS labeled, coalesce(sum(label), 0)::BIGINT AS positive FROM pred GROUP BY 1)"""


@REGISTER(f"""WITH {PRED}, {_SCORES_SQL}, r AS (SELECT model_id, 'roc_auc' AS metric, auc AS x FROM v UNION ALL SELECT model_id, 'average precision score', ap FROM v)
SELECT model_id, metric, '' AS parameter, round(x, 6) AS best_value, round(x, 6) AS worst_value, round(x, 6) AS stochastic_value, 0.0::DOUBLE AS standard_deviation, 0 AS num_sort_trials,
  labeled AS num_labeled_examples, labeled AS num_labeled_above_threshold, positive AS num_positive_labels FROM r JOIN n USING (model_id)""")
def evaluate_scores(spark, d):
    """AUC and average precision as metrics of a config."""
    return rounded(V.evaluate(predictions(spark, d), V.metric_definitions(spark, [{"metrics": ["roc_auc", "average precision score"]}])))


@REGISTER(_EVALUATE_SQL.format(pred=PRED.replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 2 = 0")))
def evaluate_subset(spark, d):
    p = predictions(spark, d)
    return rounded(V.evaluate(p, _defs(spark), subset=p.filter("entity_id % 2 = 0")))


@REGISTER(f"WITH {PRED}, {DEFS} SELECT DISTINCT model_id, metric, parameter FROM pred, defs WHERE NOT (model_id % 2 = 0 AND metric IN ('precision@', 'f1'))")
def missing_evaluations(spark, d):
    p = predictions(spark, d)
    stored = p.filter("model_id % 2 = 0").select("model_id").distinct().crossJoin(_defs(spark).filter("metric in ('precision@', 'f1')")).withColumn("stochastic_value", F.lit(0.5))
    return V.missing_evaluations(_defs(spark), p, stored)


@REGISTER(f"""WITH {PRED}, {DEFS}, {_confusion_sql('c', 'label ASC NULLS FIRST')} SELECT model_id, unit, value::DOUBLE AS value, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0), 6) AS f1_less_fpr FROM c""")
def custom_metric(spark, d):
    """A metric of one's own from the confusion counts."""
    name = "f1 less fpr@"
    V.register_metric(name, lambda: V.METRICS["f1"][0]() - F.coalesce(V.METRICS["fpr@"][0](), F.lit(0.0)), True)
    try:
        at = _defs(spark).select("unit", "value").distinct()
        defs = at.select(F.lit(name).alias("metric"), "unit", "value", F.lit(1.0).alias("beta"), F.lit("").alias("parameter"))
        out = V.metrics(V.confusion(predictions(spark, d), at, "worst"), defs, "f1_less_fpr")
    finally:
        del V.METRICS[name]
    return rounded(out.select("model_id", "unit", "value", "f1_less_fpr"))


_ATTRS = """attrs AS (SELECT o_orderkey AS entity_id, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""
_CT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, label ASC NULLS FIRST, entity_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM pred),
b AS (SELECT r.*, q || '_pct' AS parameter, rn <= floor(n * v / 100) AS p FROM r, (VALUES ('10.0', 10), ('25.0', 25)) t(q, v) WHERE label IS NOT NULL),
j AS (SELECT model_id, parameter, label, p, 'priority' AS attribute_name, priority AS attribute_value FROM b JOIN attrs USING (entity_id) UNION ALL SELECT model_id, parameter, label, p, 'status', status FROM b JOIN attrs USING (entity_id)),
ct AS (SELECT model_id, parameter, attribute_name, attribute_value, count(*) AS group_size, count(*) FILTER (WHERE label = 1) AS group_label_pos, count(*) FILTER (WHERE label = 0) AS group_label_neg, count(*) FILTER (WHERE p) AS pp, count(*) FILTER (WHERE NOT p) AS pn,
  count(*) FILTER (WHERE p AND label = 1) AS tp, count(*) FILTER (WHERE p AND label = 0) AS fp, count(*) FILTER (WHERE NOT p AND label = 0) AS tn, count(*) FILTER (WHERE NOT p AND label = 1) AS fn FROM j GROUP BY ALL),
ctt AS (SELECT *, (sum(group_size) OVER g)::BIGINT AS total_entities, (sum(pp) OVER g)::BIGINT AS k FROM ct WINDOW g AS (PARTITION BY model_id, parameter, attribute_name))"""
_RATE = {"prev": "group_label_pos / nullif(group_size, 0)", "ppr": "pp / nullif(k, 0)", "pprev": "pp / nullif(group_size, 0)", "tpr": "tp / nullif(tp + fn, 0)", "tnr": "tn / nullif(tn + fp, 0)", "for": "fn / nullif(pn, 0)", "fdr": "fp / nullif(pp, 0)", "fpr": "fp / nullif(fp + tn, 0)", "fnr": "fn / nullif(fn + tp, 0)", "npv": "tn / nullif(pn, 0)", "precision": "tp / nullif(pp, 0)", "group_size_pct": "group_size / nullif(total_entities, 0)"}
_RATES_SQL = f"rates AS (SELECT *, {', '.join(f'{e} AS \"{n}\"' for n, e in _RATE.items())} FROM ctt)"


def _crosstab(spark, d):
    attrs = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.lit("1998-01-01").cast("date").alias("as_of_date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    at = spark.createDataFrame([("pct", 10.0), ("pct", 25.0)], "unit string, value double")
    return A.group_crosstab(R.rank_predictions(predictions(spark, d), "worst"), attrs, ["priority", "status"], at)


@REGISTER(f"WITH {PRED}, {_ATTRS}, {_CT} SELECT * FROM ctt")
def group_crosstab(spark, d):
    return _crosstab(spark, d)


@REGISTER(f"WITH {PRED}, {_ATTRS}, {_CT}, {_RATES_SQL} SELECT model_id, parameter, attribute_name, attribute_value, {', '.join(f'round(\"{n}\", 6) AS \"{n}\"' for n in _RATE)} FROM rates")
def group_rates(spark, d):
    return rounded(A.group_rates(_crosstab(spark, d)).select(*A.GROUP, "attribute_value", *_RATE))


_DISP = ", ".join(f'round(a."{r}" / nullif(z."{r}", 0), 6) AS "{r}_disparity"' for r in A.RATES)
_IDS = "a.model_id, a.parameter, a.attribute_name, a.attribute_value"


@REGISTER(f"""WITH {PRED}, {_ATTRS}, {_CT}, {_RATES_SQL}, ref AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY model_id, parameter, attribute_name ORDER BY group_size DESC, attribute_value) = 1)
SELECT {_IDS}, z.attribute_value AS ref_group_value, {_DISP} FROM rates a JOIN ref z USING (model_id, parameter, attribute_name)""")
def disparity_majority(spark, d):
    out = A.disparity(A.group_rates(_crosstab(spark, d)), "majority")
    return rounded(out.select(*A.GROUP, "attribute_value", "ref_group_value", *[f"{r}_disparity" for r in A.RATES]))


@REGISTER(f"""WITH {PRED}, {_ATTRS}, {_CT}, {_RATES_SQL}, ref AS (SELECT * FROM rates WHERE attribute_value IN ('1-URGENT', 'F'))
SELECT {_IDS}, z.attribute_value AS ref_group_value, {_DISP} FROM rates a JOIN ref z USING (model_id, parameter, attribute_name)""")
def disparity_predefined(spark, d):
    out = A.disparity(A.group_rates(_crosstab(spark, d)), "predefined", {"priority": "1-URGENT", "status": "F"})
    return rounded(out.select(*A.GROUP, "attribute_value", "ref_group_value", *[f"{r}_disparity" for r in A.RATES]))


@REGISTER(f"""WITH {PRED}, {_ATTRS}, {_CT}, {_RATES_SQL}
SELECT {_IDS}, {', '.join(f'round("{r}" / nullif(min("{r}") OVER g, 0), 6) AS "{r}_disparity"' for r in A.RATES)} FROM rates a WINDOW g AS (PARTITION BY model_id, parameter, attribute_name)""")
def disparity_min(spark, d):
    return rounded(A.disparity(A.group_rates(_crosstab(spark, d)), "min").select(*A.GROUP, "attribute_value", *[f"{r}_disparity" for r in A.RATES]))


_PAR = {r: f'(a."{r}" / nullif(z."{r}", 0)) BETWEEN 0.8 AND 1.25' for r in A.RATES}


@REGISTER(f"""WITH {PRED}, {_ATTRS}, {_CT}, {_RATES_SQL}, ref AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY model_id, parameter, attribute_name ORDER BY group_size DESC, attribute_value) = 1),
p AS (SELECT {_IDS}, {', '.join(f'{e} AS "{r}_p"' for r, e in _PAR.items())} FROM rates a JOIN ref z USING (model_id, parameter, attribute_name))
SELECT model_id, parameter, attribute_name, attribute_value, ppr_p AS statistical_parity, pprev_p AS impact_parity, fdr_p AND fpr_p AS type_i_parity, for_p AND fnr_p AS type_ii_parity, fpr_p AND tpr_p AS equalized_odds,
  ppr_p OR pprev_p AS unsupervised_fairness, fdr_p AND fpr_p AND for_p AND fnr_p AS supervised_fairness FROM p""")
def parity_flags(spark, d):
    attrs = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.lit("1998-01-01").cast("date").alias("as_of_date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    at = spark.createDataFrame([("pct", 10.0), ("pct", 25.0)], "unit string, value double")
    out = pipelines.run_audit(predictions(spark, d), attrs, ["priority", "status"], at)
    return out.select(*A.GROUP, "attribute_value", "statistical_parity", "impact_parity", "type_i_parity", "type_ii_parity", "equalized_odds", "unsupervised_fairness", "supervised_fairness")


_NRANK = "ri AS (SELECT *, dense_rank() OVER (PARTITION BY model_id ORDER BY feature_importance DESC) AS rank_abs FROM imp)"
_TOP5 = "top AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY feature_importance DESC, feature) AS nth FROM imp WHERE feature_importance <> 0 QUALIFY nth <= 5)"


@REGISTER(f"WITH {IMPORTANCES}, {_NRANK} SELECT model_id, feature, feature_importance, rank_abs, round(rank_abs / max(rank_abs) OVER (PARTITION BY model_id), 8) AS rank_pct FROM ri")
def rank_importances(spark, d):
    return rounded(N.rank_importances(importances(spark, d)), 8)


@REGISTER(f"WITH {IMPORTANCES}, {_TOP5} SELECT * FROM top")
def top_features(spark, d):
    return rounded(N.top_features(importances(spark, d), 5))


@REGISTER(f"WITH {IMPORTANCES} SELECT model_id, CASE WHEN starts_with(feature, 'even_1') THEN 'even_1' WHEN starts_with(feature, 'odd') THEN 'odd' ELSE 'No feature group' END AS feature_group, max(abs(feature_importance)) AS importance FROM imp GROUP BY ALL")
def group_importances(spark, d):
    return rounded(N.group_importances(importances(spark, d), ["even_1", "odd"]))


def _four(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("model_id"))
    wide = g.agg(F.round(F.avg("l_tax"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("tax"), F.round(F.avg("l_quantity") / 1000, 6).alias("lines"))
    return wide.unpivot(["model_id"], ["quantity", "tax", "lines"], "feature", "feature_importance")


_FOUR = """w4 AS (SELECT l_linenumber::BIGINT AS model_id, round(avg(l_tax), 6) AS quantity, round(avg(l_discount), 6) AS tax, round(avg(l_quantity) / 1000, 6) AS lines FROM lineitem GROUP BY 1),
f4 AS (SELECT model_id, 'quantity' AS feature, quantity AS i FROM w4 UNION ALL SELECT model_id, 'tax', tax FROM w4 UNION ALL SELECT model_id, 'lines', lines FROM w4),
t4 AS (SELECT * FROM f4 WHERE i <> 0 QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY i DESC, feature) <= 2)"""


@REGISTER(f"""WITH {MATRIX}, {_FOUR}, l AS (SELECT entity_id, as_of_date, 'quantity' AS feature, quantity AS x FROM matrix UNION ALL SELECT entity_id, as_of_date, 'tax', tax FROM matrix UNION ALL SELECT entity_id, as_of_date, 'lines', lines FROM matrix)
SELECT model_id, entity_id, as_of_date, feature, 'uniform' AS method, round(x, 6) AS feature_value, i AS importance_score FROM l JOIN t4 USING (feature)""")
def individual_importance(spark, d):
    return rounded(N.individual_importance(matrix(spark, d), _four(spark, d), 2))


@REGISTER(f"""WITH {IMPORTANCES}, g AS (SELECT (model_id - 1) % 3 + 1 AS model_group_id, feature, avg(feature_importance) AS m, stddev_samp(feature_importance) / sqrt(count(*)) AS s FROM imp GROUP BY ALL)
SELECT model_group_id, feature, round(m, 6) AS mean_importance, round(s, 6) AS sem, row_number() OVER (PARTITION BY model_group_id ORDER BY m DESC, feature) AS nth FROM g QUALIFY nth <= 4""")
def importance_summary(spark, d):
    return rounded(N.importance_summary(importances(spark, d).withColumn("model_group_id", (F.col("model_id") - 1) % 3 + 1), 4))


def _labelled(spark, d):
    p = predictions(spark, d).filter("model_id = 1").select("entity_id", "label")
    return matrix(spark, d).join(p, "entity_id")


_SCORED = f"""{MATRIX}, y AS (SELECT l_orderkey AS entity_id, max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS label FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
m AS (SELECT * FROM matrix JOIN y USING (entity_id)), caps AS (SELECT quantile_cont(quantity, 0.99) AS q, quantile_cont(lines, 0.99) AS l FROM m),
pred AS (SELECT 1::BIGINT AS model_id, entity_id, as_of_date, round(least(quantity, q) / q * 0.75::DOUBLE + least(lines, l) / l * 0.25::DOUBLE, 8) AS score, label FROM m, caps)"""


@REGISTER(_EVALUATE_SQL.format(pred=_SCORED))
def run_scoring(spark, d):
    """Score, rank and evaluate a matrix."""
    return rounded(pipelines.run_scoring(_labelled(spark, d), ["quantity", "lines"], [3, 1], _defs(spark)))


_FORWARD_COLS = ["ev_user_7days_n_count", "ev_user_all_value_sum"]


def predict_forward(spark, d):
    """A new day's rows, scored with training ranges and ranked."""
    events = table(spark, d, "events")
    return pipelines.predict_forward(events, EVENT_DATES[-1], pipelines.training_matrix(events, EVENT_DATES[:-1]), _FORWARD_COLS, [0.5, 0.5])


def retrain_and_predict(spark, d):
    return pipelines.retrain_and_predict(table(spark, d, "events"), EVENT_CONFIG, EVENT_DATES[-1], _FORWARD_COLS, maxIter=10)


REGISTER.queries |= {"predict_forward": predict_forward, "retrain_and_predict": retrain_and_predict}

#: Events by splits of a week: two of them, with daily test rows over three days.
EVENT_CONFIG = TemporalConfig(datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 1, 1), datetime(2024, 1, 31), "7 days", ("3 days",), ("1 day",), ("14 days",), ("3 days",), ("7 days",), ("7 days",))
_SPLIT_MATRICES = """plan AS (
  SELECT split_time, 'train' AS matrix_type, (split_time - to_days((7 + 3 * i)::INTEGER))::DATE AS as_of_date FROM (VALUES (DATE '2024-01-14'), (DATE '2024-01-21')) t(split_time), range(0, 5) r(i)
  WHERE split_time - to_days((7 + 3 * i)::INTEGER) >= DATE '2024-01-01'
  UNION ALL SELECT split_time, 'test', (split_time + to_days(i::INTEGER))::DATE FROM (VALUES (DATE '2024-01-14'), (DATE '2024-01-21')) t(split_time), range(0, 3) r(i)),
dd AS (SELECT DISTINCT as_of_date FROM plan),
f AS (SELECT user_id AS entity_id, as_of_date, count(*) FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY) AS c7, count(*) AS ca, sum(value) FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY) AS s7, sum(value) AS sa FROM events, dd WHERE ts < as_of_date GROUP BY ALL),
y AS (SELECT user_id AS entity_id, as_of_date, bool_or(event_type = 'purchase')::INTEGER::BIGINT AS label FROM events, dd WHERE ts >= as_of_date AND ts < as_of_date + INTERVAL 7 DAY GROUP BY ALL),
mx AS (SELECT dense_rank() OVER (ORDER BY split_time) - 1 AS split, split_time, matrix_type, entity_id, as_of_date, c7::FLOAT::DOUBLE AS c7, coalesce(s7, 0)::FLOAT::DOUBLE AS s7, ca::FLOAT::DOUBLE AS ca, coalesce(sa, 0)::FLOAT::DOUBLE AS sa, label
  FROM plan JOIN f USING (as_of_date) LEFT JOIN y USING (entity_id, as_of_date) WHERE matrix_type = 'test' OR label IS NOT NULL)"""


def _split_matrices(spark, d):
    return pipelines.run_matrices(table(spark, d, "events"), EVENT_CONFIG)


def _feature_sets(matrices):
    return pipelines.feature_sets(matrices, {"metric": ["count", "sum"]}, ["leave-one-in"])


@REGISTER(f"WITH {_SPLIT_MATRICES} SELECT split_time, matrix_type, entity_id, as_of_date, c7 AS ev_user_7days_n_count, round(s7, 1) AS ev_user_7days_value_sum, ca AS ev_user_all_n_count, round(sa, 1) AS ev_user_all_value_sum, label FROM mx")
def run_matrices(spark, d):
    """Train and test matrices of every split."""
    cols = ["ev_user_7days_n_count", "ev_user_7days_value_sum", "ev_user_all_n_count", "ev_user_all_value_sum"]
    return rounded(_split_matrices(spark, d).select("split_time", "matrix_type", "entity_id", "as_of_date", *cols, "label"), 1)


@REGISTER(f"""WITH {_SPLIT_MATRICES} SELECT split_time, matrix_type, feature_set, columns, count(*) AS n_rows, count(label) AS n_labelled, round(avg(label), 6) AS label_rate
FROM mx, (VALUES ('metric: count', 'ev_user_7days_n_count,ev_user_all_n_count'), ('metric: sum', 'ev_user_7days_value_sum,ev_user_all_value_sum')) v(feature_set, columns) GROUP BY ALL""")
def matrix_catalogue(spark, d):
    m = _split_matrices(spark, d)
    out = pipelines.matrix_catalogue(m, _feature_sets(m)).withColumn("columns", F.concat_ws(",", "columns"))
    return rounded(out.select("split_time", "matrix_type", "feature_set", "columns", "n_rows", "n_labelled", "label_rate"))


def _scaled_sql(c: str) -> str:
    return f"greatest(0, least(1, ({c} - {c}_l) / CASE WHEN {c}_h = {c}_l THEN 1 ELSE {c}_h - {c}_l END))"


_RANGES = ", ".join(f"min({c}) AS {c}_l, max({c}) AS {c}_h" for c in ("c7", "ca", "s7", "sa"))
_EXPERIMENT_PRED = f"""{_SPLIT_MATRICES}, st AS (SELECT split, avg(label) AS rate, {_RANGES} FROM mx WHERE matrix_type = 'train' GROUP BY 1),
pred AS (SELECT split * 4 + j AS model_id, entity_id, as_of_date, round(CASE j WHEN 1 THEN ({_scaled_sql('c7')} + {_scaled_sql('ca')}) / 2 WHEN 3 THEN ({_scaled_sql('s7')} + {_scaled_sql('sa')}) / 2 ELSE rate END, 6) AS score, label
  FROM mx JOIN st USING (split), range(1, 5) r(j) WHERE matrix_type = 'test')"""


def _experiment(spark, d):
    m = cut(_split_matrices(spark, d), "matrices")
    return pipelines.run_experiment(m, EVENT_CONFIG, _feature_sets(m), [("linear", {}), ("prior", {})], _defs(spark))


@REGISTER(_EVALUATE_SQL.format(pred=_EXPERIMENT_PRED))
def run_experiment(spark, d):
    """Baselines over splits and sets of features, evaluated on their test matrices."""
    return rounded(_experiment(spark, d)["evaluations"])


@REGISTER(f"WITH {_EXPERIMENT_PRED} {_ranks_sql('worst').replace('entity_id)', 'entity_id, as_of_date)').replace('SELECT model_id, entity_id,', 'SELECT model_id, entity_id, as_of_date,')}")
def experiment_predictions(spark, d):
    return rounded(_experiment(spark, d)["predictions"].select(*_RANKS, "as_of_date"))


_LEDGER_PRED = _EXPERIMENT_PRED.replace("split * 4 + j AS model_id", "CASE WHEN j IN (1, 3) THEN split * 2 + (j + 1) // 2 ELSE 4 + split * 2 + j // 2 END AS model_id")


@REGISTER(f"WITH {_LEDGER_PRED} {_ranks_sql('worst').replace('entity_id)', 'entity_id, as_of_date)').replace('SELECT model_id, entity_id,', 'SELECT model_id, entity_id, as_of_date,')}")
def experiment_ledger(spark, d):
    """Two experiments in one path: the second adds a scorer, and the first one's models keep their ids and rows."""
    m, path = cut(_split_matrices(spark, d), "matrices"), new_path(spark, "experiments")
    auc = V.metric_definitions(spark, [{"metrics": ["roc_auc"]}])
    for scorers in ([("linear", {})], [("prior", {})], [("linear", {}), ("prior", {})]):
        out = pipelines.run_experiment(m, EVENT_CONFIG, _feature_sets(m), scorers, auc, path)
    return rounded(out["predictions"].select(*_RANKS, "as_of_date"))


_RESULTS_PRED = f"""{_EXPERIMENT_PRED.replace("pred AS (SELECT", "pb AS (SELECT matrix_type,").replace("WHERE matrix_type = 'test')", ")")},
pred AS (SELECT model_id * 4 + (matrix_type = 'test')::INTEGER AS model_id, entity_id, as_of_date, score, label FROM pb
  UNION ALL SELECT model_id * 4 + 2 + (matrix_type = 'test')::INTEGER, entity_id, as_of_date, score, label FROM pb WHERE entity_id % 2 = 0)"""


@REGISTER(f"""SELECT z.* EXCLUDE (model_id), model_id // 4 AS model_id, CASE WHEN model_id % 2 = 0 THEN 'train' ELSE 'test' END AS matrix_type, CASE WHEN model_id % 4 >= 2 THEN 'even' ELSE '' END AS subset
FROM ({_EVALUATE_SQL.format(pred=_RESULTS_PRED)}) z""")
def experiment_results(spark, d):
    """Training and test rows, all and those of even users, evaluated together."""
    m, path = cut(_split_matrices(spark, d), "matrices"), new_path(spark, "experiments")
    pipelines.run_experiment(m, EVENT_CONFIG, _feature_sets(m), [("linear", {}), ("prior", {})], _defs(spark).limit(1), path)
    even = m.filter("entity_id % 2 = 0").select("entity_id", "as_of_date")
    return rounded(pipelines.experiment_results(m, path, _defs(spark), {"even": even})["evaluations"])


def predict_with_model(spark, d):
    """The newest day's users by a logistic model that an experiment has stored."""
    m, path = cut(_split_matrices(spark, d), "matrices"), new_path(spark, "experiments")
    auc = V.metric_definitions(spark, [{"metrics": ["roc_auc"]}])
    pipelines.run_experiment(m, EVENT_CONFIG, _feature_sets(m), [("logistic", {"maxIter": 10})], auc, path)
    return pipelines.predict_with_model(table(spark, d, "events"), EVENT_DATES[-1], path, 2)


REGISTER.queries["predict_with_model"] = predict_with_model


def experiment_learned(spark, d):
    """The same with a logistic model and a tree, and the models' data beside the metrics."""
    m = cut(_split_matrices(spark, d), "matrices")
    out = pipelines.run_experiment(m, EVENT_CONFIG, _feature_sets(m), [("logistic", {"maxIter": 10}), ("tree", {"maxDepth": 3, "seed": 0})], _defs(spark))
    return out["evaluations"].join(out["models"].select("model_id", "model_group_id", "train_end_time", "feature_set", "model_type"), "model_id")


REGISTER.queries["experiment_learned"] = experiment_learned


@REGISTER(f"""WITH {MATRIX}, m AS (SELECT * FROM (VALUES (1::BIGINT, 'quantity'), (2, 'tax'), (3, 'lines')) v(model_id, c)),
t AS (SELECT model_id, entity_id, CASE c WHEN 'quantity' THEN quantity WHEN 'tax' THEN tax ELSE lines END AS score, as_of_date FROM matrix, m WHERE model_id <> 2)
SELECT model_id, entity_id, round(score, 6) AS score, rank() OVER (PARTITION BY model_id ORDER BY score DESC) AS rank_abs_with_ties FROM t""")
def add_predictions(spark, d):
    """Back-fills models 1 and 3; model 2 has its predictions already."""
    models = spark.createDataFrame([(1, "quantity"), (2, "tax"), (3, "lines")], "model_id long, column string")
    m = matrix(spark, d)
    known = m.select(F.lit(2).cast("long").alias("model_id"), "as_of_date", F.lit(1).alias("rank_abs_no_ties"))
    return rounded(pipelines.add_predictions(models, m, known).select("model_id", "entity_id", "score", "rank_abs_with_ties"))
