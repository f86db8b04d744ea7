import hashlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ttail import beta_inc
from tidemark.operators import evaluate as V
from tidemark.operators import matrix as M
from tidemark.operators import rank as R
from tidemark.operators import score as B
from tidemark.operators import selection as G

DAY = date(2016, 1, 1)


def pred(spark, scores, labels):
    rows = [(1, i, DAY, float(s), y) for i, (s, y) in enumerate(zip(scores, labels, strict=True))]
    return spark.createDataFrame(rows, "model_id long, entity_id long, as_of_date date, score double, label int")


def test_tie_orders(spark):
    p = pred(spark, [0.5, 0.4, 0.6, 0.5, 0.6], [0, 0, 1, 1, None])
    order = lambda rule: [r.entity_id for r in p.orderBy(*R.tie_order(rule)).collect()]
    assert order("best") == [2, 4, 3, 0, 1] and order("worst") == [4, 2, 0, 3, 1]
    assert order("random") == order("random")


def test_ranks_agree_with_the_distributed_way(spark):
    p = pred(spark, [0.5, 0.4, 0.6, 0.5, 0.6, 0.5], [0, 0, 1, 1, None, 1])
    a = R.rank_small_models(p, "worst").orderBy("entity_id").collect()
    b = R.rank_predictions(p, "worst").orderBy("entity_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    assert a[1].rank_pct_with_ties == 1.0 and a[2].rank_abs_with_ties == 1


def test_tie_sensitivity(spark):
    p = pred(spark, [0.56, 0.55, 0.5, 0.5, 0.3], [1, 0, 1, 0, 0])
    defs = V.metric_definitions(spark, [{"metrics": ["precision@"], "thresholds": {"top_n": [3]}}])
    row = V.evaluate(p, defs).first()
    assert row.worst_value == pytest.approx(1 / 3) and row.best_value == pytest.approx(2 / 3) and row.num_sort_trials == 30
    assert row.worst_value < row.stochastic_value < row.best_value and (row.num_labeled_examples, row.num_positive_labels) == (5, 2)


def test_one_class_has_no_auc(spark):
    assert V.roc_auc(pred(spark, [0.5, 0.4], [1, 1])).first().roc_auc is None


def test_binarize(spark):
    p = R.rank_predictions(pred(spark, [0.9, 0.8] + [0.7] * 7 + [0.6], [0] * 10), "worst")
    ones = lambda unit, v: V.binarize(p, spark.createDataFrame([(unit, v)], "unit string, value double")).agg(F.sum("predicted")).first()[0]
    assert ones("pct", 50.0) == 5 and ones("abs", 2.0) == 2


def test_rules_and_linear_scores(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (5, 1, 2.0), (None, 3, 1.0)], "x1 int, x2 int, x3 double")
    assert [r.score for r in B.score_thresholds(df, ["x1 > 0", "x2 <= 1"], "or").collect()] == [1, 1, 0]
    assert [r.score for r in B.score_thresholds(df, ["x1 > 0", "x2 <= 1"], "and").collect()] == [0, 1, 0]
    assert max(r.score for r in B.score_linear(df, ["x2", "x3"], [1, 3]).collect()) <= 1
    with pytest.raises(ValueError):
        B.rule_column("x1 about 3")


def test_percentile_and_multi_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, 1, 1, 2])], "i int, v int")
    by = lambda out: [r.score for r in out.orderBy("i").collect()]
    assert by(B.score_percentile_rank(df, "v")) == [0.75, 0, 0, 0.5]
    assert by(B.score_percentile_rank(df, "v", True)) == [0, 0.5, 0.5, 0.25]
    assert by(B.score_multi_rank(df, [("v", False)])) == [1, 0, 0, 0.5]


def test_distance_from_best(spark):
    values = {"stable": [0.6, 0.4, 0.6], "bad": [0.4, 0.39, 0.43], "spiky": [0.8, 0.5, 0.7]}
    evals, models = [], []
    for g, (name, vs) in enumerate(values.items(), 1):
        for k, v in enumerate(vs):
            t, m = date(2014 + k, 1, 1), g * 10 + k
            models.append((m, g, t))
            evals += [(m, "precision@", "100_abs", t, date(2014 + k, 6, 1), v), (m, "precision@", "100_abs", date(2014 + k, 8, 1), date(2014 + k, 9, 1), -0.15)]
    dist = G.distance_from_best(spark.createDataFrame(evals, "model_id int, metric string, parameter string, evaluation_start_time date, evaluation_end_time date, stochastic_value double"), spark.createDataFrame(models, "model_id int, model_group_id int, train_end_time date"))
    at = {(r.model_group_id, r.train_end_time.year): r for r in dist.collect()}
    assert (at[3, 2014].raw_value, at[3, 2014].dist_from_best_case, at[3, 2014].dist_from_best_case_next_time) == (0.8, 0.0, 0.0)
    assert at[1, 2014].dist_from_best_case == pytest.approx(0.2) and at[2, 2014].dist_from_best_case_next_time == pytest.approx(0.11)
    grid = G.rule_grid([{"shared_parameters": [{"metric": "precision@", "parameter": "100_abs"}], "selection_rules": [{"name": "best_current_value"}, {"name": "most_frequent_best_dist", "within": [0.1, 0.2]}]}])
    assert len(grid) == 3
    regrets = {(r.rule, r.as_of_time.year): r.regret for r in G.rule_regrets(dist, grid, "precision@", "100_abs").collect()}
    assert regrets[grid[0][0], 2014] == pytest.approx(0.0)
    assert "raw_value_next_time" not in G.history(dist).columns


def test_groups_keep_their_ids(spark):
    schema = "model_id int, model_type string, hyperparameters string, feature_list array<string>, model_config string"
    first = G.assign_model_groups(spark.createDataFrame([(1, "t", "{}", ["a", "b"], "{}"), (2, "t", "{}", ["b", "a"], "{}")], schema))
    assert len({r.model_group_id for r in first.collect()}) == 1
    known = first.select("group_key", "model_group_id").distinct()
    more = G.assign_model_groups(spark.createDataFrame([(1, "t", "{}", ["a", "b"], "{}"), (3, "u", "{}", ["a"], "{}")], schema), known)
    assert {r.model_id: r.model_group_id for r in more.collect()} == {1: 1, 3: 2}


def test_feature_groups_and_mixes():
    groups = M.feature_groups({"a": ["p_1y_x_sum", "p_all_x_sum"], "b": ["q_1y_y_max"]}, {"tables": ["a", "b"], "metric": ["max"], "interval": ["1y"]})
    assert groups["interval: 1y"] == {"a": ["p_1y_x_sum"], "b": ["q_1y_y_max"]}
    two = {"g": {}, "h": {}}
    assert M.mix_groups(two, ["all", "leave-one-out", "leave-one-in", "all-combinations"]) == [["g", "h"], ["h"], ["g"]]
    assert M.matrix_uuid({"b": 1, "a": 2}) == M.matrix_uuid({"a": 2, "b": 1})


def test_t_tail():
    # Two-sided p of t = 2.228 with 10 degrees of freedom is 0.05; of t = 1 with 1 degree, 0.5.
    assert beta_inc(np.array([5.0]), 0.5, np.array([10 / (10 + 2.2281388519649385**2)]))[0] == pytest.approx(0.05, abs=1e-6)
    assert beta_inc(np.array([0.5]), 0.5, np.array([0.5]))[0] == pytest.approx(0.5, abs=1e-9)


def test_upsert_keeps_the_last(spark):
    from tidemark.sources.tables import upsert

    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 3), (2, "d", 2), (3, None, 1)], "k long, v string, at long")
    assert sorted(map(tuple, upsert(old, new, ["k"], ["at"]).collect()), key=str) == [(1, "a", 0), (2, "c", 3), (3, None, 1)]


def test_models_without_evaluations_stay(spark):
    from tidemark.operators.reports import model_performance

    models = spark.sql("select id as model_id, 1L as model_group_id, date '2015-01-01' as train_end_time from range(2)")
    evals = spark.sql("select 1L as model_id, 'f1' as metric, '' as parameter, 0.5 as stochastic_value")
    assert {(r.model_id, r["value"] is None) for r in model_performance(models, evals, "f1", "").collect()} == {(0, True), (1, False)}


def test_directions_come_from_the_metrics(spark):
    from tidemark.operators import evaluate as V
    from tidemark.operators import selection as S

    V.register_metric("cost@", lambda: V.F.col("fp").cast("double"), False)
    try:
        assert S._signed("cost@") == -1 and S._signed("roc_auc") == 1
        assert [r[0] for r in spark.createDataFrame([("cost@",), ("fpr@",), ("f1",)], "m string").select(S.better_is_greater(V.F.col("m"))).collect()] == [False, False, True]
    finally:
        V.METRICS.pop("cost@")


def test_error_trees_for_each_model(spark):
    from tidemark.operators import analysis as A

    rows = spark.sql("select m.id as model_id, cast(r.id % 2 as int) as predicted, cast(r.id % 4 = 1 as int) as error_fp, cast(r.id % 4 = 0 as int) as error_fn, cast(r.id % 4 < 2 as int) as error, cast(r.id % 4 as double) as x, cast(m.id as double) as y from range(2) m, range(40) r")
    out = A.error_trees(rows, ["x", "y"], depths=(2,)).collect()
    assert {(r.model_id, r.target) for r in out} == {(m, t) for m in range(2) for t in ("error", "error_fp", "error_fn")}
    assert all(r.importance == (1.0 if r.feature == "x" else 0.0) for r in out)


def test_error_trees_make_their_rows_once(spark):
    """All fits read rows that were written by model; what the rows come from is run once."""
    from tidemark.operators import analysis as A

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.sql("select m.id as model_id, cast(r.id % 2 as int) as predicted, cast(r.id % 4 = 1 as int) as error_fp, cast(r.id % 4 = 0 as int) as error_fn, cast(r.id % 4 < 2 as int) as error, cast(r.id % 4 as double) as x from range(2) m, range(40) r")
    out = A.error_trees(rows.mapInArrow(count, rows.schema), ["x"], depths=(1, 2)).collect()
    assert seen.value == 80 and len(out) == 12 and all(r.importance == 1.0 for r in out)


def test_crosstabs_ask_for_one_rank(spark):
    """Crosstabs read the rows that one numbering wrote; scores and their tied ranks are not made."""
    import __spark_entry__ as entry

    df = entry.queries()["crosstab_ttest_p"](spark, "/root/testdata/sf0.001")
    assert len({f.rsplit("/", 1)[0] for f in df.inputFiles() if "/ranges-" in f}) == 1


def test_rows_of_a_batch_by_model_and_place():
    import pyarrow as pa

    from tidemark.operators.analysis import _rows_by_place

    kind = pa.list_(pa.struct([("model_id", pa.int64()), ("places", pa.list_(pa.int32()))]))
    at = lambda m, *p: {"model_id": m, "places": list(p)}
    own = pa.array([[at(9, 0, 0)], [at(1, 0, -1), at(2, 1, 0)], [], [at(2, 1, 0), at(None, 0, 0)], [at(1, 0, -1)]], kind)[1:]
    assert {k: r.tolist() for k, r in _rows_by_place(own)} == {(1, 0, -1): [0, 3], (2, 1, 0): [0, 2], (None, 0, 0): [2]}
    assert list(_rows_by_place(own[1:2])) == []


def test_group_crosstab_by_place(spark):
    """Counts by place among the cutoffs are those of each row at each threshold, without rank too."""
    from tidemark.operators.audit import group_crosstab

    rows = [(1, i, date(2016, 1, 1), [None, 0, 1][i % 3], i + 1 if i < 10 else None, "a" if i % 2 else None) for i in range(12)]
    p = spark.createDataFrame(rows, "model_id long, entity_id long, as_of_date date, label int, rank_abs_no_ties long, kind string")
    at = spark.createDataFrame([("abs", 4.0), ("pct", 50.0), ("abs", 0.0), ("abs", 6.0)], "unit string, value double")
    got = {(r.parameter, r.attribute_value): (r.group_size, r.pp, r.pn, r.tp, r.fp, r.tn, r.fn, r.k) for r in group_crosstab(p.drop("kind"), p.select("entity_id", "as_of_date", "kind"), ["kind"], at).collect()}
    want = {}
    for name, cutoff in (("4.0_abs", 4), ("50.0_pct", 6), ("0.0_abs", 0), ("6.0_abs", 6)):
        k = sum(1 for r in rows if r[3] is not None and r[4] is not None and r[4] <= cutoff)
        for kind in ("a", "None"):
            mine = [(r[3], None if r[4] is None else r[4] <= cutoff) for r in rows if r[3] is not None and (r[5] or "None") == kind]
            n = {(y, up): mine.count((y, up)) for y in (0, 1) for up in (True, False)}
            want[name, kind] = (len(mine), n[0, True] + n[1, True], n[0, False] + n[1, False], n[1, True], n[0, True], n[0, False], n[1, False], k)
    assert got == want


def test_crosstabs_of_thousands_of_features(spark):
    """2,000 features by ten cutoffs of two rank columns, against numpy; the plan has no expression for each."""
    import numpy as np

    from tidemark.operators import analysis as A

    rng = np.random.default_rng(3)
    n, width = 60, 2000
    x = rng.normal(size=(n, width)).round(3)
    x[rng.random(x.shape) < 0.1] = np.nan
    day = date(2016, 1, 1)
    names = [f"f{i}" for i in range(width)]
    import pandas as pd

    frame = pd.concat([pd.DataFrame({"entity_id": range(n), "as_of_date": [day] * n}), pd.DataFrame(x, columns=names)], axis=1)
    matrix = spark.createDataFrame(frame)
    pred = spark.createDataFrame([(m, i, day, (i * m) % n + 1, None if i == 5 else ((i * m) % n + 1) / n) for m in (1, 7) for i in range(n)], "model_id long, entity_id long, as_of_date date, r long, p double")
    cuts = [("r", float(k)) for k in (1, 3, 10, 20, 60)] + [("p", k / 10) for k in (1, 2, 5, 9, 10)]
    got = {(r.model_id, r.threshold_type, r.threshold, r.feature): r for r in A.crosstabs(pred, matrix, names, cuts).collect()}
    assert len(got) == 2 * len(cuts) * width
    for m in (1, 7):
        rank = np.array([(i * m) % n + 1 for i in range(n)], float)
        share = np.where(np.arange(n) == 5, np.nan, rank / n)
        for c, k in cuts:
            side = (rank if c == "r" else share) <= k
            rest = (rank if c == "r" else share) > k
            for f in (0, 1, 999, 1999):
                r = got[m, c, k, f"f{f}"]
                for name, rows in (("pos", side), ("neg", rest)):
                    v = x[rows, f]
                    v = v[~np.isnan(v)]
                    assert (r[f"count_{name}"], r[f"support_{name}"]) == (len(v), (v > 0).sum())
                    assert r[f"mean_{name}"] == (pytest.approx(v.mean(), abs=1e-9) if len(v) else None)
                    assert r[f"std_{name}"] == (pytest.approx(v.std(ddof=1), abs=1e-9) if len(v) > 1 else None)


def test_exact_quantiles(spark):
    from tidemark.functions.order import exact_quantiles

    rows = [(float(i * i % 97), None if i % 3 else i % 5, None) for i in range(401)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(7)
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        r = exact_quantiles(df, ["a", "b", "c"], p).first()
        assert r.a == pytest.approx(np.quantile([x for x, _, _ in rows], p)) and r.b == pytest.approx(np.quantile([x for _, x, _ in rows if x is not None], p)) and r.c is None
    assert exact_quantiles(df.limit(0), ["a"], 0.5).first().a is None


def test_tie_keys_are_made_once_for_all_models(spark):
    """Three models that tie the same rows, and one that ties some of them: the trials go over each entity once."""
    rows = [(m, e, date(2024, 1, 1), 0.5 if m < 4 or e % 2 else 0.1, None if e % 5 == 0 else e % 3 == 0) for m in range(1, 5) for e in range(60)]
    pred = spark.createDataFrame([(*r[:4], None if r[4] is None else int(r[4])) for r in rows], "model_id long, entity_id long, as_of_date date, score double, label int")
    at = spark.createDataFrame([("abs", 20.0)], "unit string, value double")
    seen, cut = {}, V.cut
    V.cut = lambda df, name="cut": seen.setdefault(name, cut(df, name))
    try:
        got = {(r.model_id, r.trial): (r.n_above, r.tp) for r in V.tie_trials(pred, at, trials=3).collect()}
    finally:
        V.cut = cut
    assert seen["tied-rows"].count() == 60  # and not a row for each model
    for m in range(1, 5):
        for t in range(1, 4):
            key = lambda r: (-r[3], hashlib.md5(f"{t}|{r[1]}|2024-01-01".encode()).hexdigest())  # noqa: B023, E731
            top = sorted((r for r in rows if r[0] == m), key=key)[:20]
            assert got[m, t] == (sum(r[4] is not None for r in top), sum(bool(r[4]) for r in top))
