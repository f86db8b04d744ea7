from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import impute as I
from tidemark.operators.entities import (
    assert_nonempty, assert_schema, assert_unique, cohort_from_events, make_labels, protected_as_of,
)


def D(text):
    return date.fromisoformat(text)


EVENTS = [(1, "2014-01-01", True), (1, "2014-11-10", False), (1, "2015-01-01", False), (1, "2015-11-10", True), (2, "2013-06-08", True), (2, "2014-06-08", False), (3, "2014-03-03", False), (3, "2014-07-24", False), (3, "2015-03-03", True), (3, "2015-07-24", False), (4, "2015-12-13", False), (4, "2016-12-13", True)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(e, D(d), o) for e, d, o in EVENTS], "entity_id int, event_date date, outcome boolean")


def test_windows(spark, events):
    agg = X.Agg("outcome", "cast(outcome as int)", ("sum", "avg", "variance"))
    out = X.spacetime_aggregate(events, "entity_id", "event_date", [D("2016-01-01"), D("2015-01-01")], ["1y", "2y", "all"], [agg], "e")
    got = {(r.entity_id, str(r.as_of_date)): r.asDict() for r in out.collect()}
    one = got[1, "2015-01-01"]
    assert [one[f"e_entity_id_{i}_outcome_sum"] for i in ("1y", "2y", "all")] == [1, 1, 1] and one["e_entity_id_all_outcome_avg"] == 0.5
    assert got[1, "2016-01-01"]["e_entity_id_1y_outcome_sum"] == 1 and got[1, "2016-01-01"]["e_entity_id_2y_outcome_avg"] == 0.5
    assert got[2, "2015-01-01"]["e_entity_id_1y_outcome_sum"] == 0 and got[2, "2015-01-01"]["e_entity_id_2y_outcome_sum"] == 1
    assert got[2, "2016-01-01"]["e_entity_id_1y_outcome_sum"] is None
    assert (4, "2015-01-01") not in got
    assert one["e_entity_id_all_outcome_variance"] == 0.5 and got[4, "2016-01-01"]["e_entity_id_all_outcome_variance"] is None


def test_windows_of_a_cohort(spark, events):
    dates = [D("2016-01-01"), D("2015-01-01")]
    cohort = spark.createDataFrame([(e, d) for e in (1, 2) for d in dates], "entity_id int, as_of_date date")
    out = X.spacetime_aggregate(events, "entity_id", "event_date", dates, ["1y", "all"], [X.Agg("n", "*", ("count",))], "e", cohort=cohort)
    assert out.count() == 4 and {r.entity_id for r in out.collect()} == {1, 2}


DATA = [(1, "2014-01-01", 60120, "good", 10000.0), (1, "2014-10-11", 60120, "good", None), (3, "2012-06-08", 60653, "bad", 342.0), (3, "2014-12-21", 60653, "inbetween", 600.0), (4, "2014-04-04", 60653, "bad", 1236.0)]


def test_imputed_features(spark):
    data = spark.createDataFrame([(e, D(d), z, c, q) for e, d, z, c, q in DATA], "entity_id int, knowledge_date date, zip int, cat string, q double")
    dates = [D("2013-09-30"), D("2014-09-30"), D("2015-01-01")]
    keys = [(1, d) for d in dates] + [(3, d) for d in dates] + [(4, d) for d in dates[1:]]
    cohort = spark.createDataFrame(keys, "entity_id int, as_of_date date")
    aggs = [X.Agg("q", "q", ("sum", "count"), rules={"sum": ("constant", 137), "count": "zero"}), *X.categorical("cat", ["good", "bad"], ("sum",), rules={"all": "null_category"})]
    raw = X.spacetime_aggregate(data, "entity_id", "knowledge_date", dates, ["all"], aggs, "p", cohort=cohort)
    out = I.assert_imputed(I.impute(cohort, raw, I.resolve_rules("p", "entity_id", ["all"], aggs)))
    got = {(r.entity_id, str(r.as_of_date)): r.asDict() for r in out.collect()}
    first = got[1, "2013-09-30"]
    assert (first["p_entity_id_all_q_sum"], first["p_entity_id_all_q_count"], first["p_entity_id_all_cat_good_sum"], first["p_entity_id_all_cat_bad_sum"], first["p_entity_id_all_cat__NULL_sum"], first["p_entity_id_all_q_imp"]) == (137, 0, 0, 0, 1, 1)
    assert got[3, "2015-01-01"]["p_entity_id_all_q_sum"] == 942 and got[3, "2015-01-01"]["p_entity_id_all_q_imp"] == 0
    assert got[1, "2015-01-01"]["p_entity_id_all_cat_good_sum"] == 2 and len(got) == 8


@pytest.mark.parametrize("rule,want", [("mean", 15.0), (("constant", 7), 7), ("zero", 0), ("zero_noflag", 0), ("binary_mode", 1)])
def test_rules(spark, rule, want):
    day = D("2016-01-01")
    cohort = spark.createDataFrame([(i, day) for i in (1, 2, 3)], "entity_id int, as_of_date date")
    feats = spark.createDataFrame([(1, day, 10.0), (2, day, 20.0)], "entity_id int, as_of_date date, p_g_all_x_max double")
    agg = X.Agg("x", "x", ("max",), rules={"all": rule})
    out = I.impute(cohort, feats, I.resolve_rules("p", "g", ["all"], [agg]))
    row = {r.entity_id: r.asDict() for r in out.collect()}[3]
    assert row["p_g_all_x_max"] == want
    assert ("p_g_all_x_imp" in row) == (rule != "zero_noflag")


def test_rule_errors(spark):
    with pytest.raises(ValueError):
        I.resolve_rules("p", "g", ["all"], [X.Agg("x", "x", ("max",))])
    day = D("2016-01-01")
    nulls = I.find_nulls(spark.createDataFrame([(1, day)], "entity_id int, as_of_date date"), spark.createDataFrame([], "entity_id int, as_of_date date, p_g_all_x_max double"))
    assert I.error_columns(nulls, I.resolve_rules("p", "g", ["all"], [X.Agg("x", "x", ("max",), rules={"all": "error"})])) == ["p_g_all_x_max"]


def test_cohorts_and_gates(spark):
    rows = [(1, "2016-01-01"), (1, "2016-04-01"), (1, "2016-03-01"), (2, "2016-01-01"), (2, "2016-01-01"), (3, "2016-01-01"), (5, "2016-03-01"), (5, "2016-04-01")]
    ev = spark.createDataFrame([(e, D(d)) for e, d in rows], "e int, d date")
    dates = [date(2016, m, 1) for m in range(1, 7)]
    got = sorted((r.entity_id, r.as_of_date.month) for r in cohort_from_events(ev, "e", "d", dates).collect())
    assert got == sorted([(e, m) for e in (1, 2, 3) for m in range(2, 7)] + [(5, m) for m in (4, 5, 6)])
    with pytest.raises(ValueError):
        assert_nonempty(cohort_from_events(ev, "e", "d", dates[:1]))
    with pytest.raises(ValueError):
        assert_unique(ev, ["e"])
    assert_schema(ev, {"e": "int", "d": "time"})
    with pytest.raises(ValueError):
        assert_schema(ev, {"e": "string"})


def test_labels(events):
    out = make_labels(events, "entity_id", "event_date", [D("2014-09-30")], ["6 months"], F.col("outcome"))
    assert {r.entity_id: r.label for r in out.collect()} == {1: 0, 3: 1}


def test_floor():
    with pytest.raises(ValueError):
        X.check_floor([D("2015-01-01")], ["1y"], D("2014-06-01"))
    X.check_floor([D("2015-01-01")], ["1y", "all"], D("2013-06-01"))


def test_as_of_join(spark):
    history = spark.createDataFrame([(1, D("2016-01-01"), "male"), (1, D("2016-03-01"), "female"), (5, D("2016-01-15"), None)], "entity_id int, event_date date, sex string")
    cohort = spark.createDataFrame([(e, D(d)) for e in (1, 4, 5) for d in ("2016-01-01", "2016-03-01", "2016-04-01")], "entity_id int, as_of_date date")
    got = {(r.entity_id, r.as_of_date.month): r.sex for r in protected_as_of(cohort, history, ["sex"], "event_date").collect()}
    assert got[1, 1] is None and got[1, 3] == "male" and got[1, 4] == "female"
    assert all(got[e, m] is None for e in (4, 5) for m in (1, 3, 4)) and len(got) == 9
