"""Cohorts, subsets, labels and protected attributes: rows of (entity, as-of date).

Dates are known when the plan is made. Events are aggregated by segments of time between the ends of all windows,
and those are merged for each date; no event is copied to its dates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.intervals import shift
from tidemark.operators.segments import Segments, State, Window, add_moments, both, either, moments, plus, window_rows
from tidemark.sources.scratch import cut


def date_array(dates: Sequence[date]) -> Column:
    return F.array(*[F.lit(d) for d in sorted(set(dates))])


def expand(events: DataFrame, dates: Sequence[date], keep) -> DataFrame:
    """Each event once for each as-of date ``d`` with ``keep(d)``; a narrow step."""
    return events.withColumn("as_of_date", F.explode(F.filter(date_array(dates), keep)))


def entity_dates(events: DataFrame, entity: str, when: str, windows: Sequence[Window]) -> DataFrame:
    """``entity_id, as_of_date`` with an event in a window of the date, once each; no row for each event and date."""
    return window_rows(events.select(entity, when), entity, when, Segments(windows), [State("_n", F.count(F.lit(1)), plus)]).select("entity_id", "as_of_date")


def cohort_from_events(events: DataFrame, entity: str, when: str, dates: Sequence[date], condition: Column | None = None, within: str | None = None) -> DataFrame:
    """Entities with an event (that meets the condition) before each date; ``within`` a time before it, where given.

    The condition is on the event alone; what depends on the date is ``within``, e.g. ``2 years``.
    """
    rows = events if condition is None else events.filter(condition)
    if within is not None:
        ends = [(d, datetime.combine(d, time())) for d in sorted(set(dates))]
        return entity_dates(rows, entity, when, [Window(d, 0, shift(at, within, -1), at) for d, at in ends]).withColumn("active", F.lit(True))
    seen = rows.groupBy(entity).agg(F.min(when).alias("_first"))  # one row per entity is enough
    return expand(seen, dates, lambda d: F.col("_first") < d).select(F.col(entity).alias("entity_id"), "as_of_date", F.lit(True).alias("active"))


def cohort_from_labels(labels: DataFrame) -> DataFrame:
    return labels.select("entity_id", "as_of_date").distinct().withColumn("active", F.lit(True))


def append_missing_dates(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose date keys it lacks."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), list(keys), "left_anti"))


def cohort_active(entities: DataFrame, entity: str, dates: Sequence[date], start: str, end: str) -> DataFrame:
    """Entities whose interval holds the date, both ends included; no end means open.

    An interval is the first date it holds and the first after it. Of an entity those are summed by date, and
    intervals that overlap or touch run together as a running sum above zero: two rows for each interval go
    into the sum, and one for each date of an entity comes out of it.
    """
    days = sorted(set(dates))
    known = date_array(days)
    before = F.size(F.filter(known, lambda d: d < F.col(start)))
    upto = F.when(F.col(end).isNull(), len(days)).otherwise(F.size(F.filter(known, lambda d: d <= F.col(end))))
    spans = entities.filter(F.col(start).isNotNull()).select(F.col(entity).alias("entity_id"), before.alias("_a"), upto.alias("_b")).filter("_a < _b").distinct()
    steps = F.explode(F.array(F.struct(F.col("_a").alias("_at"), F.lit(1).alias("_step")), F.struct(F.col("_b").alias("_at"), F.lit(-1).alias("_step"))))
    sums = spans.select("entity_id", steps.alias("_s")).groupBy("entity_id", "_s._at").agg(F.sum("_s._step").alias("_step"))
    w = W.partitionBy("entity_id").orderBy("_at")  # as many rows as dates at most
    islands = sums.withColumns({"_open": F.sum("_step").over(w), "_next": F.lead("_at").over(w)}).filter("_open > 0")
    held = islands.select("entity_id", F.explode(F.slice(known, F.col("_at") + 1, F.col("_next") - F.col("_at"))).alias("as_of_date"))
    return held.withColumn("active", F.lit(True))


def cohort_excluding(cohort: DataFrame, excluded: DataFrame, entity: str, when: str) -> DataFrame:
    """Cohort rows without an excluding event before their date."""
    first = excluded.groupBy(F.col(entity).alias("entity_id")).agg(F.min(when).alias("_first"))
    return cohort.join(first, "entity_id", "left").filter(F.col("_first").isNull() | (F.col("_first") >= F.col("as_of_date"))).drop("_first")


def subset_entity_dates(subset: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort rows that are in the subset, once each."""
    return cohort.join(subset.select("entity_id", "as_of_date"), ["entity_id", "as_of_date"], "left_semi").select("entity_id", "as_of_date").distinct().withColumn("active", F.lit(True))


#: Outcomes of a label window: an aggregate over its events and what two such are together, by name.
OUTCOMES: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "any": (F.bool_or, either),
    "every": (F.bool_and, both),
    "count": (F.count, plus),
    "sum": (F.sum, plus),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "avg": (moments, add_moments),
}


def type_of(how: str) -> str:
    return "binary" if how in ("any", "every") else "regression"


def label_columns(events: DataFrame, entity: str, when: str, dates: Sequence[date], timespans: Sequence[str], outcomes: Sequence[tuple[Column, str]]) -> DataFrame:
    """``entity_id, as_of_date, label_timespan`` and ``_label0``...: all outcomes of the events in ``[date, date + timespan)``, in one pass.

    An outcome comes with how it is taken, see ``make_labels``.
    """
    starts = [(d, datetime.combine(d, time())) for d in sorted(set(dates))]
    segments = Segments([Window(d, k, at, shift(at, span)) for d, at in starts for k, span in enumerate(timespans)])
    rows = events.select(F.col(entity).alias("entity_id"), F.col(when).alias("_when"), *[o.alias(f"_o{i}") for i, (o, _) in enumerate(outcomes)])
    made = [State(f"_label{i}", OUTCOMES[how][0](F.col(f"_o{i}")), OUTCOMES[how][1]) for i, (_, how) in enumerate(outcomes)]
    found = window_rows(rows, "entity_id", "_when", segments, [State("_any", F.count(F.lit(1)), plus), *made])

    def value(i: int, how: str) -> Column:
        own = F.col(f"_w._of._label{i}")
        return own.cast("int") if how in ("any", "every") else F.when(own["n"] > 0, own["m"]) if how == "avg" else own

    spans = F.filter(F.array(*[F.struct(F.lit(s).alias("label_timespan"), F.col(f"_w{k}").alias("_of")) for k, s in enumerate(timespans)]), lambda x: x["_of"].isNotNull())
    tall = found.select("entity_id", "as_of_date", F.explode(spans).alias("_w"))
    return tall.select("entity_id", "as_of_date", "_w.label_timespan", *[value(i, how).alias(f"_label{i}") for i, (_, how) in enumerate(outcomes)])


def make_labels(events: DataFrame, entity: str, when: str, dates: Sequence[date], timespans: Sequence[str], outcome: Column, name: str = "outcome", how: str = "any", label_type: str | None = None) -> DataFrame:
    """A label of the events in ``[date, date + timespan)``; only entities with events there have one.

    ``how`` is 1 or 0 for ``any`` or ``every`` true outcome (a null one says nothing; null if all are), else ``count``
    (of outcomes that are not null), ``sum``, ``avg``, ``min`` or ``max`` of a numeric outcome. Those are of the type ``regression``, the first two ``binary``.
    """
    kind = label_type or type_of(how)
    labels = label_columns(events, entity, when, dates, timespans, [(outcome, how)])
    return labels.select("entity_id", "as_of_date", "label_timespan", F.lit(name).alias("label_name"), F.lit(kind).alias("label_type"), F.col("_label0").alias("label"))


def assert_nonempty(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"several rows have the same {', '.join(keys)}")
    return df


#: Kinds of columns that checks know, by Spark's type names.
KINDS = {"time": ("date", "timestamp", "timestamp_ntz"), "int": ("tinyint", "smallint", "int", "bigint"), "string": ("string",), "bool": ("boolean",)}


def schema_faults(df: DataFrame, spec: dict[str, str]) -> list[str]:
    """What is wrong with the columns named in ``spec``; reads no data."""
    types = dict(df.dtypes)
    return [f"{c}: missing" if c not in types else f"{c}: {types[c]} is not {k}-like" for c, k in spec.items() if types.get(c) not in KINDS[k]]


def assert_schema(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    if faults := schema_faults(df, spec):
        raise ValueError("; ".join(faults))
    return df


def as_of_join(rows: DataFrame, history: DataFrame, keys: Sequence[str], at: str, when: str, values: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The latest history row strictly before each row's time, or nulls.

    Rows and history are stacked and parted by ranges of key and time, rows first on equal times; a running last
    value finds the match within a part, and what a key had last in the parts before is carried in. No pair of row and
    history is ever built, and a key with half of all rows lies in many parts. Among history rows of one time the
    largest ``ties`` win. Null values of the latest row stay null.
    """
    packed = F.struct(*[F.col(v) for v in values])
    left = rows.select(*rows.columns, F.col(at).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"), *[F.lit(None).cast(history.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)], F.lit(None).cast(history.select(packed.alias("v")).schema["v"].dataType).alias("_v"))
    right = history.select(*[F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.col(when).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], packed.alias("_v"))
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(ties))]]
    parted = cut(left.unionByName(right).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "as-of")
    within = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Keys that lie in several parts: one at each end of a part at most, so two rows a part, however many keys there are.
    ends = parted.groupBy(*keys, "_part").agg(F.max_by("_v", F.when(F.col("_side") == 1, F.struct(*order))).alias("_last"))
    own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    spans = ends.withColumn("_parts", F.count("*").over(W.partitionBy(*keys))).filter("_parts > 1")
    carried = spans.select(*own, F.col("_part").alias("_at"), F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    same = [F.col("_part") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]]
    found = parted.withColumn("_hit", F.last("_v", ignorenulls=True).over(within)).filter("_side = 0").join(F.broadcast(carried), same, "left")
    return found.select(*rows.columns, *[F.coalesce("_hit", "_before")[v].alias(v) for v in values])


def protected_as_of(cohort: DataFrame, source: DataFrame, attributes: Sequence[str], when: str, ties: Sequence[str] = ()) -> DataFrame:
    """The attributes known just before each cohort row's date."""
    return as_of_join(cohort.select("entity_id", "as_of_date"), source, ["entity_id"], "as_of_date", when, attributes, ties)


def key_divergence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, list(keys), "full")
    return both.filter("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))
