from datetime import date, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions.intervals import parse_interval, shift
from tidemark.operators.splits import TemporalConfig, as_of_times, chop_time, matrix_plans, split_times


def config(**more):
    base = dict(
        feature_start=datetime(1990, 1, 1), feature_end=datetime(2012, 1, 1), label_start=datetime(2010, 1, 1), label_end=datetime(2012, 1, 1), update_frequency="1 year",
        train_frequencies=("1 day",), test_frequencies=("7 days",), max_histories=("10 days",), test_durations=("1 month",), train_timespans=("3 months",), test_timespans=("1 day",),
    )
    return TemporalConfig(**(base | more))


@pytest.mark.parametrize("text,want", [("6 months", (6, "month")), ("1y", (1, "year")), ("2Y", (2, "year")), ("3 d", (3, "day")), ("5m", (5, "minute")), ("7ms", (7, "microsecond"))])
def test_intervals(text, want):
    assert parse_interval(text) == want


@pytest.mark.parametrize("text", ["month", "1 fortnight", "", "1.5 days"])
def test_bad_intervals(text):
    with pytest.raises(ValueError):
        parse_interval(text)


def test_month_ends_stay_clipped():
    assert as_of_times(datetime(2015, 1, 1), datetime(2015, 3, 31), "1 month") == [datetime(2015, 1, 28), datetime(2015, 2, 28), datetime(2015, 3, 31)]


def test_dates_backward_and_forward():
    start, end = datetime(2011, 1, 1), datetime(2011, 1, 11)
    assert as_of_times(start, end, "3 days") == [datetime(2011, 1, d) for d in (2, 5, 8, 11)]
    assert as_of_times(start, end, "3 days", forward=True) == [datetime(2011, 1, d) for d in (1, 4, 7, 10)]
    assert as_of_times(start, start, "1 day", forward=True) == [start]


def test_split_times_walk_back():
    cfg = config(feature_end=datetime(2012, 1, 1), label_end=datetime(2012, 1, 1))
    assert split_times(cfg, "3 months", "1 day", "1 month") == [datetime(2010, 11, 30), datetime(2011, 11, 30)]


def test_split_errors():
    with pytest.raises(ValueError):
        split_times(config(label_end=datetime(2013, 1, 1)), "3 days", "1 month", "6 months")
    with pytest.raises(ValueError):
        split_times(config(label_end=datetime(2010, 2, 1)), "3 days", "1 month", "6 months")
    with pytest.raises(ValueError):
        config(label_start=datetime(2013, 1, 1))


def test_plans(spark):
    cfg = config()
    plans = matrix_plans(cfg)
    assert [p["matrix_type"] for p in plans] == ["train", "test"] * 2
    train = plans[-2]
    assert train["dates"][-1] == datetime(2011, 8, 30) and train["dates"][0] == datetime(2011, 8, 20)
    rows = chop_time(spark, cfg).collect()
    assert len(rows) == sum(len(p["dates"]) for p in plans) and isinstance(rows[0].as_of_date, date)


@given(st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), st.integers(1, 50))
def test_day_shifts_undo(moment, n):
    assert shift(shift(moment, f"{n} days"), f"{n}d", -1) == moment == moment + timedelta(0)
