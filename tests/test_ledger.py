"""Experiments that share a path and resume, and learned models as tables."""

import random
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.jobs import experiment as P
from tidemark.operators import evaluate as V
from tidemark.operators import models as M
from tidemark.operators import rank as R
from tidemark.operators import score as B
from tidemark.operators.splits import TemporalConfig

CONFIG = TemporalConfig(datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 1, 1), datetime(2024, 1, 31), "7 days", ("3 days",), ("1 day",), ("14 days",), ("3 days",), ("7 days",), ("7 days",))
SCHEMA = "split int, split_time date, matrix_type string, timespan string, frequency string, entity_id long, as_of_date date, x float, y float, label int"


@pytest.fixture(scope="module")
def matrices(spark):
    """Splits 0 and 1 as the config has them; test rows may lack a feature or a label."""
    rng, rows = random.Random(1), []
    for split in (0, 1):
        for kind in ("train", "test"):
            for i in range(60):
                x = rng.random()
                label = None if kind == "test" and i % 9 == 0 else int(x + rng.random() / 2 > 0.7)
                rows.append((split, date(2024, 1, 14 + 7 * split), kind, "7 days", "1 day", i, date(2024, 1, 2), None if kind == "test" and i == 7 else x, rng.random(), label))
    return spark.createDataFrame(rows, SCHEMA)


SETS = {"both": ["x", "y"], "one": ["y"]}


def defs(spark, *more):
    return V.metric_definitions(spark, [{"metrics": ["roc_auc", *more]}, {"metrics": ["precision@"], "thresholds": {"top_n": [10]}}])


def test_two_experiments_keep_both_and_resume(spark, matrices, tmp_path, monkeypatch):
    path, made = f"file://{tmp_path}/store", []
    real_fit, real_predict = P.fit_models, P.predict
    monkeypatch.setattr(P, "fit_models", lambda train, fits: (made.append(("fit", sorted(f.model_id for f in fits))), real_fit(train, fits))[1])
    monkeypatch.setattr(P, "predict", lambda m, models, *rest: (made.append(("predict", sorted(x["model_id"] for x in models))), real_predict(m, models, *rest))[1])
    run = lambda scorers, d=defs(spark), **more: P.run_experiment(matrices, CONFIG, SETS, scorers, d, path, **more)
    first = run([("logistic", {"maxIter": 3}), ("linear", {})])
    assert made == [("fit", [1, 3, 5, 7]), ("predict", list(range(1, 9)))]
    old = {r.model_id: r for r in first["models"].collect()}
    second = run([("prior", {}), ("linear", {})])  # a second experiment: four models are new
    assert made[2:] == [("predict", [9, 10, 11, 12])]
    assert {r.model_id for r in second["models"].collect()} == {2, 4, 6, 8, 9, 10, 11, 12}
    everything = spark.read.parquet(f"{path}/predictions").groupBy("model_id").count().collect()
    assert {r.model_id: r["count"] for r in everything} == dict.fromkeys(range(1, 13), 60)
    assert {r.model_id: r for r in first["models"].collect()} == old  # ids and groups stay
    assert second["models"].select("model_group_id").distinct().count() == 4
    del made[:]
    again = run([("logistic", {"maxIter": 3}), ("linear", {})])
    assert made == [] and again["evaluations"].count() == 16
    shutil.rmtree(tmp_path / "store/predictions/model_id=3")  # one lost partition is the only one redone, from its table
    run([("logistic", {"maxIter": 3}), ("linear", {})])
    assert made == [("predict", [3])]
    shutil.rmtree(tmp_path / "store/evaluations/model_id=4")
    assert run([("linear", {})])["evaluations"].count() == 8 and len(made) == 1
    more = run([("linear", {})], defs(spark, "f1"))  # metrics that are new are added
    assert more["evaluations"].count() == 12 and len(made) == 1
    ranks = run([("linear", {})], tie_rule="random", seed=3)["predictions"]  # another tie rule ranks anew, and scores nothing
    assert len(made) == 1 and {r.tie_rule for r in ranks.select("tie_rule").distinct().collect()} == {"random:3"}
    want = R.rank_predictions(ranks.select("model_id", "entity_id", "as_of_date", "score", "label"), "random", 3)
    assert sorted(map(tuple, want.select("model_id", "entity_id", "rank_abs_no_ties").collect())) == sorted(map(tuple, ranks.select("model_id", "entity_id", "rank_abs_no_ties").collect()))
    assert {r.tie_rule for r in spark.read.parquet(f"{path}/predictions").filter("model_id = 1").select("tie_rule").distinct().collect()} == {"worst"}
    other = P.run_experiment(matrices, CONFIG, SETS, [("linear", {})], defs(spark), path, data="another cohort")
    assert {r.model_id for r in other["models"].collect()} == {13, 14, 15, 16}


def test_tables_score_as_the_models_do(spark, matrices):
    """Fifty models, one scan of the matrix, and the scores of ``transform``."""
    train, test = (matrices.filter(F.col("matrix_type") == k) for k in ("train", "test"))
    points = [("logistic", {"maxIter": 4}), ("tree", {"maxDepth": 3, "seed": 0}), ("forest", {"numTrees": 3, "maxDepth": 2, "seed": 1}), ("boosted", {"maxIter": 2, "maxDepth": 2, "seed": 2})]
    some = [M.Fit(i, i % 2, *points[i % 4 if i % 2 else (i // 2) % 4], ("x", "y") if i % 3 else ("y",)) for i in range(8)]
    tables = M.fit_models(train, some)
    got = {(r.model_id, r.entity_id): r.score for r in M.score_models(test, tables, some).collect()}
    assert len(got) == 8 * 60
    for f in some:
        [(_, _, model)] = B.train_grid(train.filter(F.col("split") == f.split), list(f.columns), {f.kind: {k: [v] for k, v in f.params.items()}})
        for r in B.score(model, test.filter(F.col("split") == f.split)).collect():
            want = r.score
            assert got[f.model_id, r.entity_id] == (None if want is None else pytest.approx(want, abs=1e-9))
            assert (want is None) == (r.entity_id == 7 and "x" in f.columns)
    fifty = [M.Fit(i, some[i % 8].split, some[i % 8].kind, some[i % 8].params, some[i % 8].columns) for i in range(50)]
    copies = None
    for i in range(50):
        one = tables.filter(F.col("model_id") == i % 8).withColumn("model_id", F.lit(i).cast("long"))
        copies = one if copies is None else copies.unionByName(one)
    wide = M.score_models(test, spark.createDataFrame(copies.collect(), copies.schema), fifty)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("MapInArrow") == 1
    assert {(r.model_id, r.entity_id): r.score for r in wide.collect()} == {(i, e): s for i in range(50) for (m, e), s in got.items() if m == i % 8}


def test_results_of_stored_models(spark, matrices, tmp_path):
    """Training rows, a subset, importances and an audit of models in a path."""
    path = f"file://{tmp_path}/store"
    P.run_experiment(matrices, CONFIG, SETS, [("logistic", {"maxIter": 3}), ("tree", {"maxDepth": 2})], defs(spark), path)
    subset = matrices.filter("entity_id < 30").select("entity_id", "as_of_date")
    people = matrices.select("entity_id", "as_of_date").distinct().withColumn("side", F.when(F.col("entity_id") < 20, "a").otherwise("b"))
    at = spark.createDataFrame([("abs", 15.0)], "unit string, value double")
    out = P.experiment_results(matrices, path, defs(spark), {"young": subset}, people, ["side"], at, top=1)
    got = {(r.model_id, r.matrix_type, r.subset, r.metric): r for r in out["evaluations"].collect()}
    assert len(got) == 8 * 2 * 2 * 2
    assert got[1, "train", "", "roc_auc"].num_labeled_examples == 60 and got[1, "train", "young", "roc_auc"].num_labeled_examples == 30
    test = {(r.model_id, r.metric): r.best_value for r in spark.read.parquet(f"{path}/evaluations").collect()}
    assert {(m, k): r.best_value for (m, t, s, k), r in got.items() if (t, s) == ("test", "")} == test
    weights = {(r.model_id, r.feature): r.feature_importance for r in out["importances"].collect()}
    assert weights[1, "x"] > 1 and sum(v for (m, _), v in weights.items() if m == 2) == pytest.approx(1)  # odds, shares of gains
    single = out["individual"].collect()
    assert len(single) == 8 * 60 and {r.feature for r in single if r.model_id in (1, 2)} == {"x"}
    assert {r.attribute_value for r in out["audit"].collect()} == {"a", "b"}


def test_splits_that_cannot_be_learned(spark, matrices):
    """One class and no rows are listed, the rest goes on; nulls in training are an error."""
    odd = matrices.filter("not (split = 1 and matrix_type = 'train')").withColumn("label", F.when((F.col("split") == 0) & (F.col("matrix_type") == "train"), F.lit(0)).otherwise(F.col("label")))
    out = P.run_experiment(odd, CONFIG, {"y": ["y"]}, [("tree", {}), ("prior", {})], defs(spark))
    assert {r.model_id: r.reason for r in out["skipped"].collect()} == {1: "one class only", 3: "no rows to train on", 4: "no rows to train on"}
    assert {r.model_id for r in out["predictions"].collect()} == {2} and out["models"].count() == 4
    model = B.train_grid(odd.filter("split = 0 and matrix_type = 'train'"), ["y"], {"tree": {"maxDepth": [1]}})[0][2]
    assert {r.score for r in B.score(model, odd.filter("matrix_type = 'test'")).collect()} == {0.0}
    with pytest.raises(ValueError, match="no rows"):
        B.train_grid(odd.limit(0), ["y"], {"tree": {"maxDepth": [1]}})
    holes = matrices.withColumn("x", F.when(F.col("entity_id") > 3, F.col("x")))
    with pytest.raises(ValueError, match="nulls"):
        P.run_experiment(holes, CONFIG, {"both": ["x", "y"]}, [("tree", {})], defs(spark))
    none = P.run_experiment(matrices.limit(0), CONFIG, {"y": ["y"]}, [("tree", {})], defs(spark))
    assert none["predictions"].count() == 0 and none["skipped"].count() == 2


def test_missing_predictions_see_ranks_and_rule(spark):
    pred = spark.createDataFrame([(1, date(2024, 1, 1), 1, 1, 0.5, 0.5, "worst"), (2, date(2024, 1, 1), 1, None, 0.5, 0.5, "worst"), (3, date(2024, 1, 1), 1, 1, 0.5, 0.5, "best")], "model_id long, as_of_date date, rank_abs_no_ties long, rank_abs_with_ties long, rank_pct_no_ties double, rank_pct_with_ties double, tie_rule string")
    models, dates = pred.select("model_id"), pred.select("as_of_date")
    assert {r.model_id for r in R.missing_predictions(models, pred, dates).collect()} == {2}
    assert {r.model_id for r in R.missing_predictions(models, pred, dates, "worst").collect()} == {2, 3}
