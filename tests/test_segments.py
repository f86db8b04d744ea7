"""Windows by segments of time against plain counting, and what their plans move."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.intervals import shift
from tidemark.operators import entities as E
from tidemark.operators import features as X
from tidemark.operators.segments import Segments, Window

DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(0, 40, 3)]


@pytest.fixture(scope="module")
def events(spark):
    """One entity has a third of all events; nulls in each column, repeated rows, events outside all windows."""
    rng = random.Random(5)
    start = datetime(2023, 11, 20)
    rows = [(0 if rng.random() < 0.35 else rng.randrange(1, 9), start + timedelta(seconds=rng.randrange(90 * 86400)), rng.choice([None, 1.5, 2.25, 8.0, -3.0, 1e4 + 0.5]), rng.choice(["a", "b", "c", None])) for _ in range(600)]
    rows += [(None, datetime(2024, 1, 5), 1.0, "a"), (3, None, 1.0, "a"), *rows[:5]]
    rows += [(1, datetime.combine(d, datetime.min.time()), 4.0, "b") for d in DAYS[:6]]  # exactly at a window's end
    return spark.createDataFrame(rows, "entity_id int, t timestamp_ntz, v double, k string")


AGGS = [
    X.Agg("n", "*", ("count",)),
    X.Agg("v", "v", ("count", "sum", "avg", "min", "max", "stddev", "variance", "mode", "percentile_50")),
    X.Agg("ago", "datediff(as_of_date, t)", ("min", "max", "sum", "avg", "stddev")),
    X.Agg("late", "case when day(as_of_date) > day(t) then v end", ("sum",)),
    X.Agg("k", "k", ("count",), distinct=True),
    X.Agg("vk", ("v", "k"), ("count",), distinct=True),
    X.Agg("pair", ("v", "day(t)"), ("corr", "regr_slope")),
    X.Agg("whole", "v", ("sum",), cast="decimal(18,0)"),
]


def rows(df):
    plain = lambda v: None if v is None or v != v else float(f"{float(v):.6g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("intervals", [["2 days", "1 month", "all"], ["36 hours", "10 days"], ["5 days"]])
@pytest.mark.parametrize("part", [False, True])
def test_segments_are_the_expansion(spark, events, monkeypatch, intervals, part):
    cohort = spark.createDataFrame([(e, d) for e in (0, 3, 5, 77) for d in DAYS[e % 2 :: 2]], "entity_id int, as_of_date date") if part else None
    made = {}
    for few in (0, 100):
        monkeypatch.setattr(X, "FEW_DATES", few)
        made[few] = X.spacetime_aggregate(events, "entity_id", "t", DAYS, intervals, AGGS, "p", cohort=cohort, input_min=F.lit(datetime(2023, 12, 1)).cast("timestamp_ntz"))
    assert made[0].columns == made[100].columns
    assert rows(made[0]) == rows(made[100]) and made[0].count() >= 20


def test_labels_and_cohorts_by_hand(events):
    got = events.collect()
    spans = ["4 days", "30 hours"]
    for how, f in {"any": lambda x: int(max(x)), "every": lambda x: int(min(x)), "count": len, "sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}.items():
        outcome = F.col("v") > 2 if how in ("any", "every") else F.col("v")
        want = {}
        for d in DAYS:
            low = datetime.combine(d, datetime.min.time())
            for s in spans:
                for r in got:
                    if r.t is not None and low <= r.t < shift(low, s):
                        own = want.setdefault((r.entity_id, d, s), [])
                        if r.v is not None:
                            own.append(r.v > 2 if how in ("any", "every") else r.v)
        empty = 0 if how == "count" else None
        labels = E.make_labels(events, "entity_id", "t", DAYS, spans, outcome, "x", how).collect()
        assert {(r.entity_id, r.as_of_date, r.label_timespan): r.label for r in labels} == {k: pytest.approx(f(v)) if v else empty for k, v in want.items()}
    kept = E.cohort_from_events(events, "entity_id", "t", DAYS, F.col("k") == "a", within="3 days").collect()
    hand = {(r.entity_id, d) for r in got for d in DAYS if r.k == "a" and r.t is not None and datetime.combine(d, datetime.min.time()) - timedelta(days=3) <= r.t < datetime.combine(d, datetime.min.time())}
    assert {(r.entity_id, r.as_of_date) for r in kept} == hand and len(kept) == len(hand)


def test_intervals_run_together(spark):
    rng = random.Random(3)
    spans = [(rng.randrange(5), a := date(2023, 12, 15) + timedelta(days=rng.randrange(60)), None if rng.random() < 0.1 else a + timedelta(days=rng.randrange(-2, 25))) for _ in range(60)] + [(9, None, None), (8, date(2030, 1, 1), None)]
    df = spark.createDataFrame(spans, "e int, a date, b date")
    got = E.cohort_active(df, "e", DAYS, "a", "b").collect()
    want = {(e, d) for e, a, b in spans for d in DAYS if a is not None and a <= d and (b is None or b >= d)}
    assert {(r.entity_id, r.as_of_date) for r in got} == want and len(got) == len(want)


def test_no_events_and_no_windows(spark, events):
    none = X.spacetime_aggregate(events.limit(0), "entity_id", "t", DAYS, ["all"], AGGS[:2], "p")
    assert none.count() == 0 and E.make_labels(events.limit(0), "entity_id", "t", DAYS, ["1 day"], F.lit(True)).count() == 0
    assert Segments([]).nodes == {}


def test_each_window_is_few_nodes():
    """400 days by three windows: each is at most twice the depth of the tree, and its nodes hold its segments once."""
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(400)]
    seg = Segments(X.interval_windows(days, ["7 days", "6 months", "all"]))
    per = {}
    for node, windows in seg.parts.items():
        for w in windows:
            per.setdefault(w, []).append(node)
    assert len(per) == 1200 and max(map(len, per.values())) <= 2 * seg.leaves.bit_length()
    w = Window(days[200], 1, shift(datetime(2024, 7, 19), "6 months", -1), datetime(2024, 7, 19))
    inside = [k for k, nodes in seg.nodes.items() for n in nodes if (w.day, 1) in seg.parts[n]]
    assert len(inside) == len(set(inside)) and sorted(inside) == [k for k in range(len(seg.cuts) + 1) if 0 < k and w.low <= seg.cuts[k - 1] < w.high]


def test_the_first_exchange_has_no_more_rows_than_events(spark, events):
    """No event is copied before the map-side combine of the first exchange, and a hot entity leaves a row a segment."""
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(400)]
    df = X.spacetime_aggregate(events, "entity_id", "t", days, ["7 days", "6 months", "all"], AGGS[:1], "p")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "Generate" not in first and "partial" in first and "explode" not in first
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_of_dates_are_neither_moved_nor_sorted(spark, events):
    """400 days by three windows, with a deviation and distinct values: after dates are there, nothing is exchanged, sorted or aggregated."""
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(400)]
    aggs = [X.Agg("v", "v", ("sum", "max", "stddev")), X.Agg("k", "k", ("count",), distinct=True)]
    plan = _plan(spark, X.spacetime_aggregate(events, "entity_id", "t", days, ["7 days", "6 months", "all"], aggs, "p"))
    above = plan[: plan.rindex("Generate explode")]
    assert not any(step in above for step in ("Exchange", "Sort", "Aggregate", "Join"))


def test_all_outcomes_in_one_pass(spark):
    import __spark_entry__ as entry

    plan = _plan(spark, entry.queries()["label_outcomes"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_windows_of_a_slot_go_by_day():
    at = lambda k: datetime(2024, 1, k)
    days, [(enter, leave)] = Segments([Window(date(2024, 1, k), 0, at(k - 2), at(k)) for k in (5, 9, 12)]).runs()
    assert [str(d) for d in days] == ["2024-01-05", "2024-01-09", "2024-01-12"] and list(zip(enter, leave)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    with pytest.raises(ValueError, match="slot 0"):
        Segments([Window(date(2024, 1, 5), 0, at(4), at(5)), Window(date(2024, 1, 6), 0, at(2), at(6))]).runs()


def test_a_key_with_half_of_all_rows_is_parted(spark):
    """The last known value is carried into the next parts of a key; nulls of the latest row stay."""
    rng = random.Random(9)
    moment = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(3000))
    history = [(0 if i % 2 else rng.randrange(40), moment(), rng.choice(["a", "b", None]), i) for i in range(3000)] + [(None, datetime(2024, 1, 2), "n", -1)]
    asked = [(0 if i % 2 else rng.randrange(45), moment().date()) for i in range(1500)] + [(None, date(2024, 2, 1)), (0, date(2023, 1, 1))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left, right = spark.createDataFrame(asked, "entity_id int, as_of_date date"), spark.createDataFrame(history, "entity_id int, t timestamp_ntz, v string, nth int")
        joined = E.as_of_join(left, right, ["entity_id"], "as_of_date", "t", ["v", "nth"], ["nth"])
        got = joined.collect()
        parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in joined.inputFiles()}).filter("entity_id = 0").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts >= 4
    want = []
    for e, d in asked:
        known = [(t, n, v) for k, t, v, n in history if k == e and t < datetime.combine(d, datetime.min.time())]
        want.append((e, d, *((max(known)[2], max(known)[1]) if known else (None, None))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_names_of_choices():
    with pytest.raises(ValueError, match="one name"):
        X.compare("c", "=", ["x" * 80, "x" * 81], ("sum",))
    assert X.compare("c" * 70, "=", [], ("sum",))[0].name.endswith("__NULL")
