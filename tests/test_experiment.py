"""Matrices over splits, the grid over them, and its stores."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.jobs import pipelines as P
from tidemark.operators import evaluate as V
from tidemark.operators import rank as R
from tidemark.operators import score as B
from tidemark.operators import selection as G
from tidemark.operators.splits import TemporalConfig, matrix_plans

CONFIG = TemporalConfig(datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 1, 1), datetime(2024, 1, 31), "7 days", ("3 days",), ("1 day",), ("14 days",), ("3 days",), ("7 days",), ("7 days",))


@pytest.fixture(scope="module")
def events(spark):
    """Forty users; odd ones buy and have many events, even ones neither."""
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(days=day, hours=h), "purchase" if u % 2 else "view", 1.0 + u) for u in range(40) for day in range(30) for h in range(1, 4 if u % 2 else 2)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")


def test_matrices_of_every_split(spark, events, tmp_path):
    m = P.run_matrices(events, CONFIG, f"file://{tmp_path}/matrices")
    plans = {(p["split"], p["matrix_type"]): {d.date() for d in p["dates"]} for p in matrix_plans(CONFIG)}
    got = {(r.split, r.matrix_type): {d for d in r.dates} for r in m.groupBy("split", "matrix_type").agg(F.collect_set("as_of_date").alias("dates")).collect()}
    first = date(2024, 1, 1)  # nobody is known on the first day
    assert got == {k: v - {first} for k, v in plans.items()}
    assert m.filter("matrix_type = 'train' and label is null").isEmpty()
    late = m.filter("matrix_type = 'train'").filter(F.date_add("as_of_date", 7) > F.col("split_time"))
    assert late.isEmpty()  # no label of training reaches past its split
    sets = P.feature_sets(m, {"metric": ["count", "sum"]}, ["all", "leave-one-in"])
    assert list(sets) == ["metric: count, metric: sum", "metric: count", "metric: sum"] and len(sets["metric: count, metric: sum"]) == 4
    found = P.matrix_catalogue(m, sets).collect()
    assert len(found) == 4 * 3 == len({r.matrix_uuid for r in found}) and all(r.n_rows >= r.n_labelled for r in found)


def test_experiment_learns_ranks_and_stores(spark, events, tmp_path):
    m = P.run_matrices(events, CONFIG, f"file://{tmp_path}/matrices")
    sets = P.feature_sets(m, {"metric": ["count"]}, ["all"])
    defs = V.metric_definitions(spark, [{"metrics": ["roc_auc"]}, {"metrics": ["precision@"], "thresholds": {"top_n": [10]}}])
    scorers = [("linear", {}), ("prior", {}), ("logistic", {"maxIter": 5}), ("tree", {"maxDepth": 2})]
    for _ in range(2):  # a second run replaces the rows of the first
        out = P.run_experiment(m, CONFIG, sets, scorers, defs, f"file://{tmp_path}/out")
    assert out["models"].count() == 8 and out["models"].select("model_group_id").distinct().count() == 4
    auc = {r.model_id: r.best_value for r in out["evaluations"].filter("metric = 'roc_auc'").collect()}
    assert auc == {i: pytest.approx(0.5 if i % 4 == 2 else 1.0) for i in range(1, 9)}
    assert out["evaluations"].count() == 16
    worst = out["predictions"].groupBy("model_id").agg(F.max("rank_abs_no_ties").alias("n"), F.count("*").alias("m")).collect()
    assert all(r.n == r.m == 40 * 3 for r in worst)


def test_retrain_by_config(events):
    got = P.retrain_and_predict(events, CONFIG, date(2024, 1, 29), ["ev_user_7days_n_count"], maxIter=5).collect()
    assert len(got) == 40 and {r.entity_id % 2 for r in got if r.rank_abs_no_ties <= 20} == {1}


def test_grid_keeps_its_order(spark):
    train = spark.createDataFrame([(i, date(2024, 1, 1), float(i % 2), i % 2) for i in range(20)], "entity_id long, as_of_date date, x double, label int")
    out = B.train_grid(train, ["x"], {"tree": {"maxDepth": [1, 2]}, "logistic": {"maxIter": [3]}})
    assert [(k, p) for k, p, _ in out] == [("tree", {"maxDepth": 1}), ("tree", {"maxDepth": 2}), ("logistic", {"maxIter": 3})]
    assert all((r.score > 0.5) == bool(r.label) for _, _, m in out for r in B.score(m, train).collect())


def _pred(spark):
    rows = [(m, i, date(2016, 1, 1), None if i % 11 == 0 else float(i * m % 4), None if i % 5 == 0 else int(i % 3 == 0)) for m in (1, 2, 3) for i in range(40)]
    return spark.createDataFrame(rows, "model_id long, entity_id long, as_of_date date, score double, label int")


def test_ranks_of_several_models(spark):
    p = _pred(spark)
    rows = lambda df: sorted(tuple(r) for r in df.select("model_id", "entity_id", "rank_abs_no_ties", "rank_abs_with_ties", "rank_pct_no_ties", "rank_pct_with_ties").collect())
    assert rows(R.rank_small_models(p, "best")) == rows(R.rank_predictions(p, "best"))
    assert R.rank_predictions(p.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["worst", "best"])
def test_counts_from_score_groups(spark, rule):
    """Null scores, missing labels, cutoffs of none and of all rows, against plain sorting."""
    p = _pred(spark)
    at = spark.createDataFrame([("abs", float(k)) for k in (0, 1, 7, 23, 40, 99)], "unit string, value double")
    got = {(r.model_id, r.value): (r.tp, r.fp, r.fn, r.tn) for r in V.confusion(p, at, rule).collect()}
    tie = {"worst": lambda y: -1 if y is None else y, "best": lambda y: 2 if y is None else -y}[rule]
    for m in (1, 2, 3):
        rows = sorted((r for r in p.collect() if r.model_id == m), key=lambda r: (r.score is None, -(r.score or 0), tie(r.label)))
        for k in (0, 1, 7, 23, 40, 99):
            up, down = [[r.label for r in part] for part in (rows[:k], rows[k:])]
            assert got[m, float(k)] == (up.count(1), up.count(0), down.count(1), down.count(0))


def test_trials_cover_only_thresholds_that_vary(spark):
    p = spark.createDataFrame([(1, i, date(2016, 1, 1), 0.5, i % 2) for i in range(10)], "model_id long, entity_id long, as_of_date date, score double, label int")
    at = spark.createDataFrame([("abs", 4.0), ("abs", 10.0)], "unit string, value double")
    got = V.tie_trials(p, at, 5).collect()
    assert sorted((r.value, r.trial) for r in got) == [(4.0, t) for t in range(1, 6)]
    for r in got:
        first = [x.label for x in p.withColumn("_k", R.tie_key(str(r.trial))).orderBy("_k").limit(4).collect()]
        assert (r.tp, r.fp) == (first.count(1), first.count(0)) and r.tp + r.fn == r.fp + r.tn == 5


def test_lowest_variance_gates(spark):
    cols = "model_group_id long, metric string, parameter string, train_end_time date, as_of_time date, raw_value double"
    one, two = date(2015, 1, 1), date(2016, 1, 1)
    rows = [(g, "precision@", "100_abs", one, at, 0.5) for g in (1, 2) for at in (one, two)]
    full = spark.createDataFrame([*rows, (1, "precision@", "100_abs", two, two, 0.9), (2, "precision@", "100_abs", two, two, 0.6)], cols)
    picked = G.picks(G.rule_lowest_variance(full, "precision@", "100_abs")).collect()
    assert {(r.as_of_time, r.model_group_id) for r in picked} == {(one, 1), (two, 2)}
    mixed = spark.createDataFrame([*rows, (1, "precision@", "100_abs", two, two, 0.9)], cols)
    with pytest.raises(Exception, match="without a deviation"):
        G.picks(G.rule_lowest_variance(mixed, "precision@", "100_abs")).collect()


def test_a_share_is_a_double(spark):
    """29 % of 100 rows are 28."""
    p = spark.createDataFrame([(1, i, date(2016, 1, 1), float(i), i % 2) for i in range(100)], "model_id long, entity_id long, as_of_date date, score double, label int")
    at = spark.createDataFrame([("pct", 29.0), ("pct", 10.0)], "unit string, value double")
    assert {r.value: r.tp + r.fp for r in V.confusion(p, at, "worst").collect()} == {29.0: 28, 10.0: 10}


def test_fallback_ranks_and_tiles(spark):
    from pyspark.sql import Window as W

    rows = [(m, date(2016, 1, d), i, float(i * 7 % 13), None if i % 4 else i, None) for m, d, n in ((1, 1, 257), (1, 2, 42), (2, 1, 100)) for i in range(n)]
    p = spark.createDataFrame(rows, "model_id long, as_of_date date, entity_id long, score double, rank_abs_no_ties long, rank_pct_no_ties double")
    w = W.partitionBy("model_id", "as_of_date").orderBy(F.col("score").desc(), "entity_id")
    want = p.select("model_id", "as_of_date", "entity_id", F.coalesce("rank_abs_no_ties", F.row_number().over(w)), F.ntile(100).over(w).cast("double"))
    got = R.fallback_ranks(p).select("model_id", "as_of_date", "entity_id", "rank_abs", "rank_pct")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_grid_scores_in_one_scan_and_trains_in_bounded_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, date(2024, 1, 1), i % 7, float(i % 7 > 3), None if i == 5 else float(i % 5)) for i in range(400)], "entity_id long, as_of_date date, label int, x double, y double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m").withColumn("label", (F.col("label") > 3).cast("int"))
    assert B.spread(m, 400).rdd.getNumPartitions() == 1
    monkeypatch.setattr(B, "ROWS_A_TASK", 100)
    dealt = B.spread(m, 400)
    assert dealt.rdd.getNumPartitions() == 4 and sorted(dealt.collect(), key=lambda r: r.entity_id) == m.orderBy("entity_id").collect()
    fits = B.train_grid(m, ["x"], {"tree": {"maxDepth": [1, 2]}}) + B.train_grid(m.filter("y is not null"), ["x", "y"], {"forest": {"numTrees": [2], "seed": [1]}})
    models = [model for _, _, model in fits]
    out = B.score_grid(models, m)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.model_id, r.entity_id): r.score for r in out.collect()}
    for i, model in enumerate(models):
        assert {e: s for (k, e), s in got.items() if k == i} == {r.entity_id: r.score for r in B.score(model, m).collect()}
    assert len(got) == 1200 and {k for k, s in got.items() if s is None} == {(2, 5)} and got[0, 4] == 1.0
