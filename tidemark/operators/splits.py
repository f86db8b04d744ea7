"""Temporal train and test splits. The plan is a handful of dates, made on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.intervals import shift


@dataclass(frozen=True)
class TemporalConfig:
    """When features and labels are known, and how the timeline is cut. Lists are crossed."""

    feature_start: datetime
    feature_end: datetime
    label_start: datetime
    label_end: datetime
    update_frequency: str
    train_frequencies: tuple[str, ...]
    test_frequencies: tuple[str, ...]
    max_histories: tuple[str, ...]
    test_durations: tuple[str, ...]
    train_timespans: tuple[str, ...]
    test_timespans: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.feature_start > self.feature_end or self.label_start > self.label_end:
            raise ValueError("a start time lies after its end time")


def split_times(cfg: TemporalConfig, train_timespan: str, test_timespan: str, test_duration: str) -> list[datetime]:
    """Ends of training, oldest first.

    The last one leaves room for the test rows and their labels; the others are one update earlier
    each, as long as one training label fits in after the data begin.
    """
    last_label = shift(cfg.label_end, test_timespan, -1)
    if last_label > cfg.feature_end:
        raise ValueError("the last test label date lies after the end of the features")
    moment, earliest = shift(last_label, test_duration, -1), shift(max(cfg.feature_start, cfg.label_start), train_timespan)
    if moment < earliest:
        raise ValueError("no split fits into the temporal config")
    found = []
    while moment >= earliest:
        found.append(moment)
        moment = shift(moment, cfg.update_frequency, -1)
    return found[::-1]


def as_of_times(start: datetime, end: datetime, frequency: str, forward: bool = False) -> list[datetime]:
    """Dates of rows. Backward from ``end``, both ends included; or forward from ``start``, which is
    always included, up to before ``end``. Each step starts from the last date, so a month end that
    was clipped stays clipped."""
    found, moment = [], start if forward else end
    while moment < end or not found if forward else moment >= start:
        found.append(moment)
        moment = shift(moment, frequency, 1 if forward else -1)
    return found if forward else found[::-1]


def training_times(cfg: TemporalConfig, at: datetime, timespan: str, frequency: str, history: str) -> list[datetime]:
    """Dates of the rows to train on for a split at ``at``: the last one's labels are known by then."""
    last = shift(at, timespan, -1)
    return as_of_times(max(cfg.feature_start, cfg.label_start, shift(last, history, -1)), last, frequency)


def matrix_plans(cfg: TemporalConfig) -> list[dict]:
    """One plan per matrix: ``split, split_time, matrix_type, timespan, frequency, history, dates``."""
    plans, split = [], 0
    for train_span, test_span, duration in product(cfg.train_timespans, cfg.test_timespans, cfg.test_durations):
        times = split_times(cfg, train_span, test_span, duration)
        for frequency, history, at in product(cfg.train_frequencies, cfg.max_histories, times):
            train = training_times(cfg, at, train_span, frequency, history)
            plans.append({"split": split, "split_time": at, "matrix_type": "train", "timespan": train_span, "frequency": frequency, "history": history, "dates": train})
            for test_frequency in cfg.test_frequencies:
                test = as_of_times(at, shift(at, duration), test_frequency, forward=True)
                plans.append({"split": split, "split_time": at, "matrix_type": "test", "timespan": test_span, "frequency": test_frequency, "history": duration, "dates": test})
            split += 1
    return plans


def chop_time(spark: SparkSession, cfg: TemporalConfig) -> DataFrame:
    """All matrices' dates: ``split, split_time, matrix_type, timespan, frequency, as_of_date``."""
    rows = [(p["split"], p["split_time"].date(), p["matrix_type"], p["timespan"], p["frequency"], d.date()) for p in matrix_plans(cfg) for d in p["dates"]]
    return spark.createDataFrame(rows, "split int, split_time date, matrix_type string, timespan string, frequency string, as_of_date date")


def all_as_of_dates(plan: DataFrame) -> DataFrame:
    """Each date of the plan once, with each timespan it is labelled for."""
    return plan.select("as_of_date", F.col("timespan").alias("label_timespan")).distinct()
