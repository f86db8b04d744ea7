"""Queries over result tables: analysis of lists and errors, curves, reports, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.jobs.fixtures import EVALS, IMPORTANCES, MATRIX, MODELS, PRED, Register, evaluations, importances, matrix, models, predictions, rounded, table
from tidemark.jobs.queries_matrix import COHORT_SQL, LABELS_SQL, _cohort, _events, _labels
from tidemark.jobs.fixtures import AS_OF, EVENT_DATES
from tidemark.jobs.pipelines import matrix_features
from tidemark.operators import analysis as X
from tidemark.operators import reports as Q
from tidemark.operators.audit import disparity, group_rates
from tidemark.operators.rank import number_predictions, rank_predictions
from tidemark.sources import tables as S
from tidemark.sources.scratch import new_path

REGISTER = Register()

RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, label ASC NULLS FIRST, entity_id) AS rn FROM pred)"


def _ranked(spark, d):
    return rank_predictions(predictions(spark, d), "worst")


_CT = f"""WITH {PRED}, {MATRIX}, {RANKED}, j AS (SELECT model_id, rn <= 500 AS p, quantity, tax, lines FROM ranked JOIN matrix USING (entity_id)),
l AS (SELECT model_id, p, 'quantity' AS feature, quantity AS x FROM j UNION ALL SELECT model_id, p, 'tax', tax FROM j UNION ALL SELECT model_id, p, 'lines', lines FROM j),
ct AS (SELECT model_id, feature, count(x) FILTER (WHERE p) AS count_pos, count(x) FILTER (WHERE NOT p) AS count_neg, avg(x) FILTER (WHERE p) AS mean_pos, avg(x) FILTER (WHERE NOT p) AS mean_neg,
  stddev_samp(x) FILTER (WHERE p) AS std_pos, stddev_samp(x) FILTER (WHERE NOT p) AS std_neg, count(*) FILTER (WHERE p AND x > 0) AS support_pos, count(*) FILTER (WHERE NOT p AND x > 0) AS support_neg FROM l GROUP BY ALL)"""


def _crosstabs(spark, d):
    return X.crosstabs(number_predictions(predictions(spark, d), "worst"), matrix(spark, d), ["quantity", "tax", "lines"], [("rank_abs_no_ties", 500)])


@REGISTER(_CT + """ SELECT model_id, feature, count_pos, count_neg, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg, round(std_pos, 6) AS std_pos, round(std_neg, 6) AS std_neg, support_pos, support_neg, round(mean_pos / nullif(mean_neg, 0), 6) AS ratio,
  round(greatest(mean_pos / nullif(mean_neg, 0), mean_neg / nullif(mean_pos, 0)), 6) AS max_ratio, round(support_pos / nullif(count_pos, 0), 3) AS support_pct_pos, round(support_neg / nullif(count_neg, 0), 3) AS support_pct_neg FROM ct""")
def crosstabs(spark, d):
    return rounded(_crosstabs(spark, d).drop("threshold_type", "threshold"))


@REGISTER(_CT + " SELECT model_id, feature, round((mean_pos - mean_neg) / sqrt(std_pos * std_pos / count_pos + std_neg * std_neg / count_neg), 6) AS ttest_t FROM ct")
def crosstab_ttest(spark, d):
    return rounded(X.crosstab_ttest(_crosstabs(spark, d)).select("model_id", "feature", "ttest_t"))


def crosstab_ttest_p(spark, d):
    return X.crosstab_ttest(_crosstabs(spark, d)).select("model_id", "feature", "ttest_t", "ttest_p")


REGISTER.queries["crosstab_ttest_p"] = crosstab_ttest_p


@REGISTER("""SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER::BIGINT AS "o_orderstatus_F", (o_orderstatus = 'O')::INTEGER::BIGINT AS "o_orderstatus_O", (o_orderstatus = 'P')::INTEGER::BIGINT AS "o_orderstatus_P", (o_orderstatus IS NULL)::INTEGER::BIGINT AS o_orderstatus_nan FROM orders""")
def dummify(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("nothing"))
    return rounded(X.dummify(rows, ["o_orderstatus", "nothing"]))


@REGISTER(f"WITH {PRED} SELECT model_id, entity_id, score FROM pred WHERE model_id IN (1, 2) AND entity_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def scope(spark, d):
    only = spark.createDataFrame([(1,), (2,)], "model_id long")
    return X.scope(predictions(spark, d), models=only, entities=table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity_id"))).select("model_id", "entity_id", "score")


@REGISTER(f"""WITH {PRED}, {RANKED}, e AS (SELECT *, (rn <= 300)::INTEGER AS predicted FROM ranked WHERE label IS NOT NULL)
SELECT model_id, entity_id, predicted::BIGINT AS predicted, CASE WHEN predicted = 1 AND label = 1 THEN 'TP' WHEN predicted = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS kind, (predicted <> label)::INTEGER::BIGINT AS error,
  (predicted = 1 AND label = 0)::INTEGER::BIGINT AS error_fp, (predicted = 0 AND label = 1)::INTEGER::BIGINT AS error_fn FROM e""")
def error_labels(spark, d):
    return rounded(X.error_labels(_ranked(spark, d), 300).select("model_id", "entity_id", "predicted", "kind", "error", "error_fp", "error_fn"))


def error_trees(spark, d):
    rows = X.error_labels(_ranked(spark, d), 3000).join(matrix(spark, d), ["entity_id", "as_of_date"])
    return X.error_trees(rows, ["quantity", "tax", "lines"])


REGISTER.queries["error_trees"] = error_trees


@REGISTER(f"""WITH {PRED}, {RANKED}, t AS (SELECT * FROM ranked WHERE rn <= 500), m AS (SELECT model_id, count(*) AS n FROM t GROUP BY 1),
b AS (SELECT a.model_id AS model_1, b.model_id AS model_2, count(*) AS n_both, corr(a.rn, b.rn) AS c FROM t a JOIN t b USING (entity_id) WHERE a.model_id < b.model_id GROUP BY ALL)
SELECT x.model_id AS model_1, y.model_id AS model_2, coalesce(n_both, 0) AS n_both, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard, round(coalesce(n_both, 0) / least(x.n, y.n), 6) AS overlap,
  CASE WHEN n_both > 1 THEN round(c, 6) END AS rank_corr FROM m x JOIN m y ON x.model_id < y.model_id LEFT JOIN b ON model_1 = x.model_id AND model_2 = y.model_id""")
def pairwise_lists(spark, d):
    return rounded(X.pairwise_lists(_ranked(spark, d), 500))


@REGISTER(f"""WITH {IMPORTANCES}, t AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY feature_importance DESC, feature) AS rn FROM imp QUALIFY rn <= 6), m AS (SELECT model_id, count(*) AS n FROM t GROUP BY 1),
b AS (SELECT a.model_id AS model_1, b.model_id AS model_2, count(*) AS n_both, corr(a.rn, b.rn) AS c FROM t a JOIN t b USING (feature) WHERE a.model_id < b.model_id GROUP BY ALL)
SELECT x.model_id AS model_1, y.model_id AS model_2, coalesce(n_both, 0) AS n_both, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard, round(coalesce(n_both, 0) / least(x.n, y.n), 6) AS overlap,
  CASE WHEN n_both > 1 THEN round(c, 6) END AS rank_corr FROM m x JOIN m y ON x.model_id < y.model_id LEFT JOIN b ON model_1 = x.model_id AND model_2 = y.model_id""")
def pairwise_features(spark, d):
    return rounded(X.pairwise_features(importances(spark, d), 6))


@REGISTER(f"""WITH {PRED}, {RANKED}, l AS (SELECT model_id, label, row_number() OVER (PARTITION BY model_id ORDER BY rn) AS k FROM ranked WHERE label IS NOT NULL), n AS (SELECT model_id, count(*) AS n, sum(label) AS p FROM l GROUP BY 1),
g AS (SELECT model_id, n, p, i AS k_pct, round_even(i * n / 100.0::DOUBLE, 0)::BIGINT AS c FROM n, range(0, 101, 5) r(i))
SELECT g.model_id, k_pct, round(coalesce(sum(label) / nullif(any_value(c), 0), 0), 6) AS precision, round(coalesce(sum(label) / nullif(any_value(p), 0), 0), 6) AS recall FROM g LEFT JOIN l ON l.model_id = g.model_id AND k <= c GROUP BY g.model_id, k_pct""")
def pr_k_curve(spark, d):
    return rounded(X.pr_k_curve(_ranked(spark, d), 5))


@REGISTER(f"""WITH {PRED}, e AS (SELECT model_id, min(score) AS lo, max(score) AS hi, avg(score) AS m FROM pred GROUP BY 1)
SELECT model_id, CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 7)), 6) END::BIGINT AS bin, count(*) AS n, round(any_value(m), 6) AS mean_score, any_value(lo) AS lo, any_value(hi) AS hi FROM pred JOIN e USING (model_id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY model_id, bin"))
def score_histogram(spark, d):
    return rounded(X.score_histogram(predictions(spark, d), 7))


@REGISTER(f"""WITH {PRED}, e AS (SELECT model_id, label, min(score) AS lo, max(score) AS hi, avg(score) AS m FROM pred WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT model_id, label::BIGINT AS label, CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 7)), 6) END::BIGINT AS bin, count(*) AS n, round(any_value(m), 6) AS mean_score, any_value(lo) AS lo, any_value(hi) AS hi FROM pred JOIN e USING (model_id, label) GROUP BY 1, 2, 3""")
def score_histogram_by_label(spark, d):
    return rounded(X.score_histogram(predictions(spark, d), 7, by_label=True))


@REGISTER(f"WITH {PRED} SELECT model_id, greatest(0, least(6, ceil(score * 7)::INTEGER - 1))::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS pct_positive FROM pred WHERE label IS NOT NULL GROUP BY 1, 2")
def calibration(spark, d):
    return rounded(X.calibration(predictions(spark, d), 7))


@REGISTER(f"WITH {EVALS} SELECT model_id, 100.0::DOUBLE AS list_size, stochastic_value::DOUBLE AS value FROM evals WHERE metric = 'precision@' AND split_part(parameter, '_', 2) = 'abs'")
def threshold_curve(spark, d):
    return rounded(X.threshold_curve(evaluations(spark, d), "precision@", "abs"))


_AUD = """ct AS (SELECT l_linenumber::BIGINT * 10000 + year(l_shipdate) AS model_id, '100_abs' AS parameter, 'line status' AS attribute_name, l_linestatus AS attribute_value, count(*) AS gs, count(*) FILTER (WHERE l_discount >= 0.08) AS pp FROM lineitem GROUP BY ALL),
ref AS (SELECT model_id, pp / gs AS r FROM ct QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY gs DESC, attribute_value) = 1),
audit AS (SELECT model_id, attribute_name, attribute_value, (pp / gs) / nullif(r, 0) AS d FROM ct JOIN ref USING (model_id))"""


def _audit(spark, d):
    """Counts by line status of lines with a high discount, as an audit table."""
    line, year = F.col("l_linenumber").cast("long"), F.year("l_shipdate").cast("long")
    y, p = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.08
    ct = table(spark, d, "lineitem").groupBy((line * 10000 + year).alias("model_id"), F.lit("100_abs").alias("parameter"), F.lit("line status").alias("attribute_name"), F.col("l_linestatus").alias("attribute_value")).agg(
        F.count("*").alias("group_size"), F.count_if(y).alias("group_label_pos"), F.count_if(~y).alias("group_label_neg"), F.count_if(p).alias("pp"), F.count_if(~p).alias("pn"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"),
    ).withColumns({"total_entities": F.col("group_size"), "k": F.col("pp")})
    return disparity(group_rates(ct), "majority")


@REGISTER(f"WITH {EVALS}, {_AUD}, a AS (SELECT * FROM audit WHERE attribute_value = 'F') SELECT e.model_id, e.stochastic_value::DOUBLE AS performance, round(1 / nullif(d, 0), 6) AS disparity FROM evals e LEFT JOIN a USING (model_id) WHERE metric = 'precision@'")
def disparity_vs_performance(spark, d):
    return rounded(X.disparity_vs_performance(evaluations(spark, d), _audit(spark, d), "precision@", "100_abs", "line status", "F", "pprev", invert=True))


@REGISTER(f"""WITH {PRED}, g AS (SELECT model_id, score, sum(label) AS p, count(*) AS m FROM pred WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT model_id, score, round(sum(m - p) OVER w / nullif(sum(m - p) OVER a, 0), 6) AS fpr, round(sum(p) OVER w / nullif(sum(p) OVER a, 0), 6) AS tpr, round(sum(m) OVER w / sum(m) OVER a, 6) AS list_pct FROM g
WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model_id)""")
def roc_points(spark, d):
    return rounded(X.roc_points(predictions(spark, d)))


@REGISTER(f"WITH {LABELS_SQL} SELECT label_name, label_timespan, as_of_date, count(DISTINCT entity_id) AS cohort_size, round(avg(label), 6) AS base_rate FROM labels GROUP BY ALL")
def cohort_report(spark, d):
    return rounded(Q.cohort_report(_labels(spark, d)))


@REGISTER(f"WITH {LABELS_SQL}, {COHORT_SQL} SELECT label_name, label_timespan, as_of_date, count(DISTINCT entity_id) AS subset_size, round(avg(label) * 100, 6) AS base_rate_pct FROM labels SEMI JOIN (SELECT * FROM cohort WHERE entity_id % 3 = 0) s USING (entity_id, as_of_date) GROUP BY ALL")
def subset_report(spark, d):
    return rounded(Q.subset_report(_labels(spark, d), _cohort(spark, d).filter("entity_id % 3 = 0")))


@REGISTER(f"WITH {EVALS} SELECT evaluation_start_time, num_labeled_examples, num_positive_labels, round(num_positive_labels / nullif(num_labeled_examples, 0), 6) AS base_rate FROM evals QUALIFY row_number() OVER (PARTITION BY evaluation_start_time ORDER BY model_id, metric, parameter) = 1")
def evaluation_cohort_summary(spark, d):
    return rounded(Q.evaluation_cohort_summary(evaluations(spark, d)))


@REGISTER(f"""WITH {COHORT_SQL}, f AS (SELECT user_id AS entity_id, as_of_date, count(*) FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY) AS n7 FROM events, ({AS_OF}) WHERE ts < as_of_date GROUP BY ALL),
x AS (SELECT as_of_date, sum((coalesce(n7, 0) = 0)::INTEGER) * 100 / count(*) AS s7 FROM cohort LEFT JOIN f USING (entity_id, as_of_date) GROUP BY 1)
SELECT feature, CASE WHEN feature = 'ev_user_7days_value_imp' THEN round(avg(s7), 6) ELSE 0 END::DOUBLE AS mean_pct, CASE WHEN feature = 'ev_user_7days_value_imp' THEN round(min(s7), 6) ELSE 0 END::DOUBLE AS min_pct, CASE WHEN feature = 'ev_user_7days_value_imp' THEN round(max(s7), 6) ELSE 0 END::DOUBLE AS max_pct
FROM x, (VALUES ('ev_user_7days_n_imp'), ('ev_user_7days_value_imp'), ('ev_user_all_n_imp'), ('ev_user_all_value_imp')) v(feature) GROUP BY feature""")
def feature_missingness(spark, d):
    return rounded(Q.feature_missingness(matrix_features(_events(spark, d), _cohort(spark, d), EVENT_DATES)))


@REGISTER(f"WITH {MODELS} SELECT model_group_id, model_type, count(DISTINCT model_id) AS n_models, count(DISTINCT train_end_time) AS n_splits FROM models GROUP BY ALL")
def group_summary(spark, d):
    return Q.group_summary(models(spark, d))


@REGISTER(f"WITH {MODELS}, {EVALS} SELECT model_id, model_group_id, train_end_time, stochastic_value::DOUBLE AS value FROM models LEFT JOIN (SELECT * FROM evals WHERE metric = 'precision@' AND parameter = '100_abs') e USING (model_id)")
def model_performance(spark, d):
    return rounded(Q.model_performance(models(spark, d), evaluations(spark, d), "precision@", "100_abs"))


@REGISTER(f"WITH {MODELS}, {EVALS} SELECT model_id, model_group_id, train_end_time, coalesce(CASE WHEN model_id % 2 = 0 THEN 'even' END, 'full_cohort') AS subset, stochastic_value::DOUBLE AS value FROM models LEFT JOIN (SELECT * FROM evals WHERE metric = 'precision@') e USING (model_id)")
def subset_performance(spark, d):
    e = evaluations(spark, d).withColumn("subset_hash", F.when(F.col("model_id") % 2 == 0, "even"))
    return rounded(Q.subset_performance(models(spark, d), e, "precision@", "100_abs"))


@REGISTER(f"""WITH {MODELS}, {EVALS}, {_AUD}, r AS (SELECT m.model_group_id, attribute_name, attribute_value, e.stochastic_value AS v, d FROM models m LEFT JOIN (SELECT * FROM evals WHERE metric = 'precision@') e USING (model_id) LEFT JOIN audit USING (model_id))
SELECT model_group_id, attribute_name, attribute_value, round(avg(v), 6) AS mean_value, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem_value, round(avg(d), 6) AS mean_disparity, round(stddev_samp(d) / sqrt(count(d)), 6) AS sem_disparity FROM r GROUP BY ALL""")
def efficiency_equity(spark, d):
    return rounded(Q.efficiency_equity(models(spark, d), evaluations(spark, d), _audit(spark, d), "precision@", "100_abs", "pprev"))


_MEAN = f"WITH {MODELS}, {EVALS}, g AS (SELECT model_type, model_group_id, hyperparameters, avg(stochastic_value) AS m FROM models JOIN evals USING (model_id) WHERE metric = 'precision@' AND evaluation_start_time = train_end_time GROUP BY ALL)"


def _first_evals(spark, d):
    return evaluations(spark, d).filter("evaluation_start_time = trunc(evaluation_start_time, 'year')")


@REGISTER(_MEAN + " SELECT model_type, model_group_id, hyperparameters, round(m, 6) AS mean_value FROM g QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY m DESC, model_group_id) = 1")
def best_per_type(spark, d):
    return rounded(Q.best_per_type(models(spark, d), _first_evals(spark, d), "precision@", "100_abs"))


@REGISTER(_MEAN + " SELECT model_group_id, round(m, 6) AS mean_value FROM g ORDER BY m DESC, model_group_id LIMIT 2")
def best_groups(spark, d):
    return rounded(Q.best_groups(models(spark, d), _first_evals(spark, d), "precision@", "100_abs", 2))


@REGISTER(f"WITH {MODELS}, x AS (SELECT model_group_id, count(*) AS n_models, count(DISTINCT train_end_time) AS n_matrices FROM models GROUP BY 1) SELECT count(*) AS n_experiments, max(n_models) AS most_models, sum(n_models)::BIGINT AS models, sum(n_matrices)::BIGINT AS matrices, sum((model_group_id <> 2)::INTEGER)::BIGINT AS completed FROM x")
def experiment_stats(spark, d):
    x = models(spark, d).groupBy(F.col("model_group_id").alias("experiment_hash")).agg(F.count("*").alias("n_models"), F.count_distinct("train_end_time").alias("n_matrices"))
    return Q.experiment_stats(x.withColumn("status", F.when(F.col("experiment_hash") != 2, "completed").otherwise("failed")))


@REGISTER("SELECT DISTINCT o_custkey FROM orders ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') b USING (o_custkey)")
def missing_artifacts(spark, d):
    o = table(spark, d, "orders")
    return Q.missing_artifacts(o, o.filter("o_orderstatus = 'F'").select("o_custkey").distinct(), "o_custkey")


@REGISTER(f"""WITH {MODELS}, one AS (SELECT * FROM models WHERE model_group_id IN (1, 2) QUALIFY row_number() OVER (PARTITION BY model_group_id, train_end_time ORDER BY model_id DESC) = 1)
SELECT model_id, model_group_id, train_end_time, 'train' || year(train_end_time) AS train_matrix_uuid, 'test' || year(train_end_time) AS test_matrix_uuid FROM one""")
def models_for_groups(spark, d):
    m = models(spark, d)
    kinds = m.select("train_end_time").distinct().withColumn("matrix_type", F.explode(F.array(F.lit("train"), F.lit("test")))).withColumn("matrix_uuid", F.concat("matrix_type", F.year("train_end_time").cast("string")))
    return Q.models_for_groups(m, kinds, [1, 2])


@REGISTER(f"WITH {PRED} SELECT model_id, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT model_id, score + CASE WHEN model_id = 2 THEN 1 ELSE 0 END AS score FROM pred) GROUP BY 1")
def write_predictions(spark, d):
    """Stores predictions, then replaces those of model 2 only."""
    p, path = predictions(spark, d), new_path(spark, "predictions")
    S.write_predictions(p, path)
    S.write_predictions(p.filter("model_id = 2").withColumn("score", F.col("score") + 1), path)
    return rounded(spark.read.parquet(path).groupBy(F.col("model_id").cast("long").alias("model_id")).agg(F.count("*").alias("n"), F.sum("score").alias("total")), 4)


@REGISTER(f"WITH {MATRIX} SELECT entity_id, as_of_date, quantity::FLOAT::DOUBLE AS quantity, round(tax::FLOAT::DOUBLE, 6) AS tax, lines, part::FLOAT::DOUBLE AS part FROM matrix")
def write_matrix_csv(spark, d):
    """A matrix through gzipped CSV."""
    from tidemark.operators.matrix import downcast

    m, path = downcast(matrix(spark, d)), new_path(spark, "matrix")
    S.write_matrix(m, path, "csv")
    return rounded(S.read_matrix(spark, path, m.schema, "csv"))


@REGISTER(f"WITH {EVALS}, f AS (SELECT model_id, metric, parameter, stochastic_value FROM evals WHERE evaluation_start_time = make_date(year(evaluation_start_time), 1, 1)) SELECT model_id, metric, parameter, CASE WHEN model_id % 2 = 0 THEN -0.15 ELSE stochastic_value END::DOUBLE AS stochastic_value FROM f")
def upsert(spark, d):
    e = evaluations(spark, d)
    cols = ["model_id", "metric", "parameter", "stochastic_value"]
    old, new = _first_evals(spark, d).select(cols), e.filter("stochastic_value = -0.15 and model_id % 2 = 0").select(cols)
    return rounded(S.upsert(old, new, cols[:3]))
