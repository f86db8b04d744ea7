"""Queries over evaluations of many models: groups, distances, thresholds, rules, regrets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.jobs import pipelines
from tidemark.jobs.fixtures import EVALS, MODELS, Register, evaluations, models, rounded
from tidemark.operators import selection as G

REGISTER = Register()

DIST = f"""{MODELS}, {EVALS}, f AS (SELECT * FROM evals QUALIFY row_number() OVER (PARTITION BY model_id, metric, parameter ORDER BY evaluation_start_time, evaluation_end_time) = 1),
v AS (SELECT model_group_id, metric, parameter, train_end_time, avg(stochastic_value) AS raw_value FROM f JOIN models USING (model_id) GROUP BY ALL),
b AS (SELECT *, max(raw_value) OVER (PARTITION BY metric, parameter, train_end_time) AS best_case FROM v),
dist AS (SELECT *, abs(best_case - raw_value) AS dist_from_best_case, lead(raw_value) OVER w AS raw_value_next_time, lead(abs(best_case - raw_value)) OVER w AS dist_from_best_case_next_time
  FROM b WINDOW w AS (PARTITION BY model_group_id, metric, parameter ORDER BY train_end_time))"""
HIST = f"""{DIST}, h AS (SELECT t.as_of_time, dist.* FROM dist JOIN (SELECT DISTINCT train_end_time AS as_of_time FROM dist) t ON train_end_time <= as_of_time),
p AS (SELECT * FROM h WHERE metric = 'precision@' AND parameter = '100_abs')"""
P = ("precision@", "100_abs")


def _dist(spark, d):
    return G.distance_from_best(evaluations(spark, d), models(spark, d))


def _h(spark, d):
    return G.history(_dist(spark, d))


def _pick(value: str) -> str:
    return f"SELECT as_of_time, model_group_id FROM ({value}) QUALIFY row_number() OVER (PARTITION BY as_of_time ORDER BY value ASC NULLS LAST, model_group_id) = 1"


def _picked(df):
    return G.picks(df).select("as_of_time", "model_group_id")


@REGISTER(f"""WITH {MODELS}, k AS (SELECT DISTINCT model_type, hyperparameters FROM models), kk AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(31), model_type, hyperparameters, 'a,b', '{{"label_name": "x"}}'))) AS g FROM k)
SELECT model_id, g AS group_id FROM models JOIN kk USING (model_type, hyperparameters)""")
def assign_model_groups(spark, d):
    full = models(spark, d).drop("model_group_id").withColumns({"feature_list": F.when(F.col("model_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a"))), "model_config": F.lit('{"label_name": "x"}')})
    return G.assign_model_groups(full).select("model_id", F.col("model_group_id").cast("long").alias("group_id"))


@REGISTER(f"WITH {MODELS} SELECT DISTINCT model_group_id FROM models WHERE model_type <> 'tree'")
def select_groups(spark, d):
    groups = models(spark, d).withColumn("model_config", F.lit('{"label_name": "x"}'))
    return G.select_groups(groups, "x", ["tree"], False)


@REGISTER(f"WITH {MODELS} SELECT DISTINCT train_end_time FROM models WHERE train_end_time >= DATE '1998-01-01'")
def train_end_times(spark, d):
    return G.train_end_times(models(spark, d), date(1998, 1, 1))


@REGISTER(f"WITH {MODELS} SELECT model_group_id FROM models WHERE train_end_time IN (DATE '1998-01-01', DATE '1999-01-01') GROUP BY 1 HAVING count(DISTINCT train_end_time) = 2")
def filter_complete_groups(spark, d):
    return G.filter_complete_groups(models(spark, d), [date(1998, 1, 1), date(1999, 1, 1)])


@REGISTER(f"WITH {DIST} SELECT model_group_id, metric, parameter, train_end_time, round(raw_value, 8) AS raw_value, round(best_case, 8) AS best_case, round(dist_from_best_case, 8) AS dist_from_best_case, round(raw_value_next_time, 8) AS raw_value_next_time, round(dist_from_best_case_next_time, 8) AS dist_from_best_case_next_time FROM dist")
def distance_from_best(spark, d):
    return rounded(_dist(spark, d), 8)


@REGISTER(f"""WITH {DIST}, o AS (SELECT metric, parameter, min(raw_value) AS a, max(raw_value) AS z FROM dist GROUP BY ALL)
SELECT metric, parameter, round(a, 8) AS observed_min, round(z, 8) AS observed_max, CASE WHEN a >= 0 AND z <= 1 THEN 0.0 ELSE round(a - 0.1 * (z - a), 8) END::DOUBLE AS plot_min, CASE WHEN a >= 0 AND z <= 1 THEN 1.0 ELSE round(z + 0.1 * (z - a), 8) END::DOUBLE AS plot_max FROM o""")
def observed_bounds(spark, d):
    return rounded(G.observed_bounds(_dist(spark, d)), 8)


@REGISTER(f"WITH {DIST}, x AS (SELECT round(i * (0.1::DOUBLE / 100), 10) AS distance FROM range(0, 101) r(i)) SELECT model_group_id, metric, parameter, distance, round(avg((dist_from_best_case <= distance)::INTEGER), 8) AS pct_of_time FROM dist, x GROUP BY ALL")
def best_distance_curve(spark, d):
    return G.best_distance_curve(_dist(spark, d), 0.1).withColumn("pct_of_time", F.round("pct_of_time", 8))


_TIMES = [date(y, 1, 1) for y in (1997, 1998, 1999)]
_FILTERS = [{"metric": "precision@", "parameter": "100_abs", "max_from_best": 0.01, "threshold_value": 0.1}, {"metric": "recall@", "parameter": "100_abs", "max_from_best": 0.02, "threshold_value": 0.1}]
_PAST = f"""WITH {DIST}, t AS (SELECT model_group_id, train_end_time, bool_and(raw_value >= 0.1) AS p, bool_and(dist_from_best_case < CASE metric WHEN 'precision@' THEN 0.01 ELSE 0.02 END) AS c, count(*) AS n
  FROM dist WHERE train_end_time IN (DATE '1997-01-01', DATE '1998-01-01', DATE '1999-01-01') GROUP BY ALL), good AS (SELECT model_group_id FROM t GROUP BY 1 HAVING bool_and(p AND n = 2) AND bool_or(c AND n = 2) AND count(*) = 3)"""


@REGISTER(_PAST + " SELECT model_group_id FROM good")
def threshold_groups(spark, d):
    return G.threshold_groups(_dist(spark, d), _FILTERS, _TIMES)


VALUES = {
    "random_model_group": "SELECT DISTINCT as_of_time, model_group_id, md5(concat_ws('|', '0', model_group_id)) AS value FROM p",
    "best_current_value": "SELECT as_of_time, model_group_id, -raw_value AS value FROM p WHERE train_end_time = as_of_time",
    "best_average_value": "SELECT as_of_time, model_group_id, -avg(raw_value) AS value FROM p GROUP BY ALL",
    "lowest_metric_variance": "SELECT as_of_time, model_group_id, stddev_samp(raw_value) AS value FROM p GROUP BY ALL",
    "most_frequent_best_dist": "SELECT as_of_time, model_group_id, -avg((dist_from_best_case <= 0.005)::INTEGER) AS value FROM p GROUP BY ALL",
    "best_average_two_metrics": "SELECT as_of_time, model_group_id, -avg(v) AS value FROM (SELECT as_of_time, model_group_id, train_end_time, sum(raw_value * 0.5) AS v FROM h GROUP BY ALL) GROUP BY ALL",
    "best_avg_var_penalized": "SELECT as_of_time, model_group_id, -(m - 0.5 * (s - min(s) OVER (PARTITION BY as_of_time))) AS value FROM (SELECT as_of_time, model_group_id, avg(raw_value) AS m, coalesce(stddev_samp(raw_value), 0) AS s FROM p GROUP BY ALL)",
    "best_avg_recency_weight": """SELECT as_of_time, model_group_id, -sum(raw_value * w) / sum(w) AS value FROM (SELECT *, 1 + 4 * coalesce(date_diff('day', min(train_end_time) OVER g, train_end_time) / nullif(date_diff('day', min(train_end_time) OVER g, max(train_end_time) OVER g), 0), 0) AS w
      FROM p WINDOW g AS (PARTITION BY as_of_time)) GROUP BY ALL""",
}
GRID = G.rule_grid([{"shared_parameters": [{"metric": "precision@", "parameter": "100_abs"}], "selection_rules": [{"name": n} for n in VALUES if n != "most_frequent_best_dist"] + [{"name": "most_frequent_best_dist", "within": [0.005]}]}])
LABELS = {rule: label for label, rule, _ in GRID}


def _register_rule(rule: str, **args) -> None:
    def query(spark, d):
        return _picked(G.RULES[rule](_h(spark, d), *P, **args))

    query.__name__ = f"rule_{rule}"
    REGISTER(f"WITH {HIST} {_pick(VALUES[rule])}")(query)


for _rule in VALUES:
    _register_rule(_rule, **({"within": 0.005} if _rule == "most_frequent_best_dist" else {}))

_ALL_PICKS = " UNION ALL ".join(f"SELECT '{LABELS[r]}' AS rule, * FROM ({_pick(v)})" for r, v in VALUES.items())
_REGRETS = f"""picks AS ({_ALL_PICKS}), regrets AS (SELECT rule, as_of_time, k.model_group_id, n.dist_from_best_case_next_time AS regret, n.raw_value_next_time
  FROM picks k JOIN dist n ON n.model_group_id = k.model_group_id AND n.train_end_time = k.as_of_time AND n.metric = 'precision@' AND n.raw_value_next_time IS NOT NULL)"""


@REGISTER(f"WITH {HIST}, {_REGRETS} SELECT rule, as_of_time, model_group_id, round(regret, 8) AS regret, round(raw_value_next_time, 8) AS raw_value_next_time FROM regrets")
def rule_regrets(spark, d):
    return rounded(G.rule_regrets(_dist(spark, d), GRID, *P), 8)


@REGISTER(f"WITH {HIST}, {_REGRETS} SELECT rule, round(avg(regret), 8) AS average_regret, count(*) AS n_times FROM regrets GROUP BY 1")
def average_regret(spark, d):
    return rounded(G.average_regret(G.rule_regrets(_dist(spark, d), GRID, *P)), 8)


@REGISTER(f"WITH {HIST}, {_REGRETS}, x AS (SELECT round(i * (0.05::DOUBLE / 100), 10) AS regret_at FROM range(0, 101) r(i)) SELECT rule, regret_at, round(avg((regret < regret_at)::INTEGER), 8) AS pct_of_time FROM regrets, x GROUP BY ALL")
def regret_curve(spark, d):
    return G.regret_curve(G.rule_regrets(_dist(spark, d), GRID, *P), 0.05).withColumn("pct_of_time", F.round("pct_of_time", 8))


@REGISTER(f"WITH {HIST}, picks AS ({_ALL_PICKS}) SELECT rule, as_of_time, model_group_id FROM picks WHERE as_of_time = (SELECT max(train_end_time) FROM dist)")
def rule_winners(spark, d):
    return G.rule_winners(_dist(spark, d), GRID).select("rule", "as_of_time", "model_group_id")


@REGISTER(f"WITH {DIST} SELECT model_group_id::VARCHAR AS series, train_end_time, round(raw_value, 8) AS value FROM dist WHERE metric = 'precision@' AND model_group_id IN (1, 3) UNION SELECT 'best case', train_end_time, round(best_case, 8) FROM dist WHERE metric = 'precision@'")
def group_performance(spark, d):
    return rounded(G.group_performance(_dist(spark, d), [1, 3], *P), 8)


@REGISTER(f"""{_PAST.replace(DIST, HIST)}, hh AS (SELECT * FROM h SEMI JOIN good USING (model_group_id)), pp AS (SELECT * FROM p SEMI JOIN good USING (model_group_id)), """ + _REGRETS.replace(" FROM p ", " FROM pp ").replace(" FROM p)", " FROM pp)").replace("FROM p WINDOW", "FROM pp WINDOW").replace(" FROM h ", " FROM hh ").replace("FROM p GROUP", "FROM pp GROUP") + " SELECT rule, round(avg(regret), 8) AS average_regret, count(*) AS n_times FROM regrets GROUP BY 1")
def run_selection(spark, d):
    """Complete groups past the thresholds, and the mean regret of each rule among them."""
    groups = G.filter_complete_groups(models(spark, d), _TIMES)
    return rounded(pipelines.run_selection(_dist(spark, d), groups, _FILTERS, _TIMES, GRID, *P), 8)
