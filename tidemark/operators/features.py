"""Feature aggregation over events as they were known on each as-of date.

An event counts for a date when its knowledge date lies strictly before it and, unless ``all`` is
among the intervals, not before the date less the widest interval; each interval's aggregates see
the events from the date less that interval on (included). All dates and intervals share one aggregation
by segments of time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import back, parse_interval, shift, slug
from tidemark.operators.entities import date_array, entity_dates
from tidemark.operators.segments import Segments, State, Window, add_moments, comoments, merge_comoments, moments, plus, window_nodes, window_rows

#: Aggregates that take the plain quantity.
BASIC = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp, "mode": lambda c: F.mode(c, True)}
TWO = ("corr", "regr_slope")


@dataclass(frozen=True)
class Agg:
    """Metrics of a quantity. ``quantity`` is a SQL expression (it may use ``as_of_date``), ``*``, or
    a pair for two-argument metrics; ``distinct`` counts distinct values (of a tuple, nulls included).
    ``percentile`` is given as e.g. ``percentile_50``. ``rules`` are imputation rules by metric."""

    name: str
    quantity: str | tuple[str, ...]
    metrics: tuple[str, ...]
    distinct: bool = False
    cast: str | None = None
    rules: dict = field(default_factory=dict, hash=False)
    categorical: bool = False

    def column(self, metric: str, inside: Column | None) -> Column:
        """The aggregate over the events for which ``inside`` holds."""

        def only(c: Column) -> Column:
            return c if inside is None else F.when(inside, c)

        if self.distinct:
            parts = self.quantity if isinstance(self.quantity, tuple) else (self.quantity,)
            value = F.struct(*[F.expr(p) for p in parts]) if len(parts) > 1 else F.expr(parts[0])
            out = F.count_distinct(only(value))
        elif metric in TWO:
            y, x = (only(F.expr(q)) for q in self.quantity)
            own = {"y": F.covar_pop(y, F.when(x.isNotNull(), y)), "x": F.covar_pop(x, F.when(y.isNotNull(), x))}  # over whole pairs
            out = F.try_divide(F.covar_pop(y, x), F.sqrt(own["y"] * own["x"]) if metric == "corr" else own["x"])  # null without scatter
        elif metric.startswith("percentile_"):
            out = F.percentile(only(F.expr(self.quantity)), float(metric.split("_")[1]) / 100)
        else:
            out = BASIC[metric](only(F.lit(1) if self.quantity == "*" else F.expr(self.quantity)))
        return out.cast(self.cast) if self.cast else out


def compare(col: str, op: str, choices: Sequence, metrics: tuple[str, ...], include_null: bool = True, names: dict | None = None, max_len: int = 63, rules: dict | None = None) -> list[Agg]:
    """One 0/1 quantity per choice, ``col op choice``; a null column gives null and is ignored by
    sums, except for the null indicator. Names are cut to ``max_len`` characters, but for the ``__NULL`` of the indicator;
    choices that then have one name are an error."""

    def name(label: object) -> str:
        return f"{col}_{label}"[:max_len]

    out = []
    for c in choices:
        literal = "NULL" if c is None else str(c) if isinstance(c, (int, float)) else "'" + str(c).replace("'", "''") + "'"
        out.append(Agg(name((names or {}).get(c, c)), f"cast(`{col}` {op} {literal} as int)", metrics, rules=rules or {}, categorical=True))
    if include_null:
        out.append(Agg(col[: max_len - len("__NULL")] + "__NULL", f"cast(`{col}` is null as int)", metrics, rules=rules or {}, categorical=True))
    if len({a.name for a in out}) < len(out):
        raise ValueError(f"choices of {col} have one name within {max_len} characters: give them names")
    return out


def categorical(col: str, choices: Sequence, metrics: tuple[str, ...], **more) -> list[Agg]:
    """Equality with each choice; a ``None`` among the choices asks for the null indicator only once."""
    return compare(col, "=", [c for c in choices if c is not None], metrics, include_null=True, **more)


def array_categorical(col: str, choices: Sequence[str], metrics: tuple[str, ...], rules: dict | None = None) -> list[Agg]:
    """1 if the array has the choice."""
    quoted = [(c, "'" + c.replace("'", "''") + "'") for c in choices]
    return [Agg(f"{col}_{c}", f"cast(array_contains(`{col}`, {q}) as int)", metrics, rules=rules or {}, categorical=True) for c, q in quoted]


def choices_from(df: DataFrame, col: str, most: int = 1000) -> list:
    """Distinct values, sorted; more than ``most`` is an error, for each becomes a column."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} values")
    return [r[0] for r in rows]


def feature_name(prefix: str, group: str, interval: str, quantity: str, metric: str) -> str:
    return f"{prefix}_{group}_{slug(interval)}_{quantity}_{metric}".replace('"', "")


def feature_names(prefix: str, group: str, intervals: Sequence[str], aggs: Sequence[Agg]) -> list[str]:
    return [feature_name(prefix, group, i, a.name, m) for i in intervals for a in aggs for m in a.metrics]


def _lower(intervals: Sequence[str], at: Column) -> Column | None:
    """The start of the widest window; none if ``all`` is asked for."""
    if "all" in intervals:
        return None
    starts = [back(at, i) for i in intervals]
    return starts[0] if len(starts) == 1 else F.least(*starts)


def interval_windows(dates: Sequence[date], intervals: Sequence[str]) -> list[Window]:
    """The windows before each date; slots are the intervals' places in the list."""
    ends = [(d, datetime.combine(d, time())) for d in sorted(set(dates))]
    return [Window(d, k, None if i == "all" else shift(at, i, -1), at) for d, at in ends for k, i in enumerate(intervals)]


def check_floor(dates: Sequence[date], intervals: Sequence[str], floor) -> None:
    """No window may reach back before the floor."""
    for d in dates:
        for i in intervals:
            if i != "all" and shift(d, i, -1) < floor:
                raise ValueError(f"the window of {i} before {d} reaches back before {floor}")


def known_events(events: DataFrame, when: str, dates: Sequence[date], intervals: Sequence[str], cohort: DataFrame | None = None, entity: str | None = None, input_min: Column | None = None) -> DataFrame:
    """Each event with each as-of date it counts for: by the cohort's own dates (an equi-join on the
    entity), or else by a narrow expansion over the dates."""
    rows = events if input_min is None else events.filter(F.col(when) >= input_min)

    def keep(d: Column) -> Column:
        low = _lower(intervals, d)
        return (F.col(when) < d) if low is None else (F.col(when) < d) & (F.col(when) >= low)

    if cohort is None:
        return rows.withColumn("as_of_date", F.explode(F.filter(date_array(dates), keep)))
    # One row per entity carries its dates, so events are multiplied only by dates that count.
    own = cohort.filter(F.col("as_of_date").isin(list(dates))).groupBy(F.col("entity_id").alias("_cohort_id")).agg(F.collect_set("as_of_date").alias("_dates"))
    joined = rows.join(own, F.col(entity) == F.col("_cohort_id"))
    return joined.withColumn("as_of_date", F.explode(F.filter("_dates", keep))).drop("_cohort_id", "_dates")


#: Dates up to which events are copied to their dates before one aggregation; it affects speed only.
FEW_DATES = 4

#: A quantity that is a number of days before the date: it differs between dates by their distance alone.
_DAYS_BEFORE = re.compile(r"\s*datediff\(\s*as_of_date\s*,(?P<rest>.*)\)\s*", re.IGNORECASE | re.DOTALL)


class _States:
    """States of quantities, each made once, and how metrics follow from them."""

    def __init__(self, ref: date):
        self.ref, self.states = ref, {"_any": State("_any", F.count(F.lit(1)), plus)}
        self.names: dict[tuple, str] = {}

    def _state(self, kind: str, quantity, of: Column, fold) -> str:
        name = self.names.setdefault((kind, quantity), f"_{kind}{len(self.names)}")
        self.states.setdefault(name, State(name, of, fold))
        return name

    def metric(self, agg: Agg, metric: str, got) -> Column:
        """The metric from ``got(state)``, the merged state of an interval's window."""
        relative = isinstance(agg.quantity, str) and _DAYS_BEFORE.fullmatch(agg.quantity) is not None
        text = re.sub(r"\bas_of_date\b", f"date'{self.ref}'", agg.quantity, flags=re.IGNORECASE) if relative else agg.quantity
        x, later = F.lit(1) if text == "*" else F.expr(text), F.datediff("as_of_date", F.lit(self.ref))
        n = F.coalesce(got(self._state("count", text, F.count(x), plus)), F.lit(0)) if metric in ("count", "sum", "avg") else None
        if metric == "count":
            return n
        if metric in ("sum", "avg"):
            total = got(self._state("sum", text, F.sum(x), plus))
            total = total + later * n if relative else total
            return total if metric == "sum" else F.try_divide(total, n)
        if metric in ("min", "max"):
            f, fold = {"min": (F.min, F.least), "max": (F.max, F.greatest)}[metric]
            value = got(self._state(metric, text, f(x), fold))
            return value + later if relative else value
        s = got(self._state("moments", text, moments(x), add_moments))
        variance = F.when(s["n"] > 1, F.try_divide(s["q"], s["n"] - 1))
        return F.sqrt(variance) if metric == "stddev" else variance


def _by_date(agg: Agg) -> bool:
    """The quantity depends on the date in a way that no state of the events alone can follow."""
    parts = agg.quantity if isinstance(agg.quantity, tuple) else (agg.quantity,)
    relative = not agg.distinct and len(parts) == 1 and (found := _DAYS_BEFORE.fullmatch(parts[0])) and "as_of_date" not in found["rest"].lower()
    return any("as_of_date" in p.lower() for p in parts) and not (relative and all(m in ("count", "sum", "avg", "min", "max", "stddev", "variance") for m in agg.metrics))


def _by_value(agg: Agg, metric: str) -> bool:
    return not agg.distinct and (metric == "mode" or metric.startswith("percentile_"))


def _value_metrics(agg: Agg, rows: DataFrame, entity: str, when: str, segments: Segments, intervals: Sequence[str], prefix: str, group: str, own: DataFrame | None) -> DataFrame:
    """Metrics of the values themselves: how often an entity has each of them is counted by segment and merged for each
    window, then the most frequent (the least of them) or percentiles are taken."""
    values = rows.select(F.col(entity).alias("_e"), F.col(when).alias("_t"), F.expr(agg.quantity).alias("_v0")).filter("_v0 is not null")
    found = window_nodes(values, "_e", "_t", segments, F.count(F.lit(1)), F.sum, ["_v0"], own)
    counts = found.groupBy("entity_id", "_v0", "as_of_date", "_slot").agg(F.sum("_n").alias("_n"))

    def column(slot: int, metric: str) -> Column:
        inside = F.col("_slot") == slot
        if metric == "mode":
            return F.min(F.when(inside, F.struct(-F.col("_n"), F.col("_v0").alias("v"))))["v"]
        return F.percentile(F.when(inside, F.col("_v0")), float(metric.split("_")[1]) / 100, F.col("_n"))

    columns = {feature_name(prefix, group, i, agg.name, m): column(k, m) for k, i in enumerate(intervals) for m in agg.metrics if _by_value(agg, m)}
    return counts.groupBy("entity_id", "as_of_date").agg(*[(c.cast(agg.cast) if agg.cast else c).alias(n) for n, c in columns.items()])


def _pair_metrics(agg: Agg, rows: DataFrame, entity: str, when: str, segments: Segments, intervals: Sequence[str], prefix: str, group: str, own: DataFrame | None) -> DataFrame:
    """Metrics of two quantities: moments of their pairs by segment, merged for each window."""
    y, x = (F.expr(q) for q in agg.quantity)
    found = window_nodes(rows, entity, when, segments, comoments(y, x), merge_comoments, (), own)

    def column(slot: int, metric: str) -> Column:
        s = merge_comoments(F.when(F.col("_slot") == slot, F.col("_n")))
        value = F.try_divide(s["c"], F.sqrt(s["qy"] * s["qx"]) if metric == "corr" else s["qx"])
        # What the rounding of equal values leaves is no scatter.
        scatter = lambda q, m: s[q] > s["n"] * (s[m] * 1e-13) * (s[m] * 1e-13)
        return F.when((s["n"] > 1) & scatter("qx", "mx") & (scatter("qy", "my") if metric == "corr" else F.lit(True)), value)

    columns = {feature_name(prefix, group, i, agg.name, m): column(k, m) for k, i in enumerate(intervals) for m in agg.metrics if m in TWO and not agg.distinct}
    return found.groupBy("entity_id", "as_of_date").agg(*[(c.cast(agg.cast) if agg.cast else c).alias(n) for n, c in columns.items()])


def _at_each_date(events: DataFrame, entity: str, when: str, dates: Sequence[date], intervals: Sequence[str], aggs: Sequence[Agg], prefix: str, group: str, cohort: DataFrame | None) -> DataFrame:
    """For few dates, and for quantities that depend on the date: each event once for each date it counts for."""
    rows = known_events(events, when, dates, intervals, cohort, entity)
    flags = {i: None if i == "all" or intervals == [i] else F.col(when) >= back(F.col("as_of_date"), i) for i in intervals}
    columns = [a.column(m, flags[i]).alias(feature_name(prefix, group, i, a.name, m)) for i in intervals for a in aggs for m in a.metrics]
    return rows.groupBy(F.col(entity).alias("entity_id"), "as_of_date").agg(*columns)


def spacetime_aggregate(events: DataFrame, entity: str, when: str, dates: Sequence[date], intervals: Sequence[str], aggs: Sequence[Agg], prefix: str, group: str = "entity_id", cohort: DataFrame | None = None, input_min: Column | None = None) -> DataFrame:
    """``entity_id, as_of_date`` and a column per interval, quantity and metric. An entity without
    any counting event is absent; one without events in a narrow window has count 0 and sum null.

    Events are aggregated by entity and segment of time, whatever the number of dates (see ``segments``); metrics of
    the values themselves by entity, value and segment. Quantities that depend on the date otherwise than as a
    number of days before it are computed for each event and date, and so are all for up to FEW_DATES dates: that
    takes one exchange in place of two."""
    days, intervals = sorted(set(dates)), list(intervals)
    rows = events if input_min is None else events.filter(F.col(when) >= input_min)
    if len(days) <= FEW_DATES:
        return _at_each_date(rows, entity, when, days, intervals, aggs, prefix, group, cohort)
    own = None
    if cohort is not None:
        # One row per entity carries its dates.
        own = cohort.filter(F.col("as_of_date").isin(days)).groupBy("entity_id").agg(F.collect_set(F.col("as_of_date").cast("date")).alias("_dates"))
        rows = rows.join(own.select("entity_id").withColumnRenamed("entity_id", "_cohort"), F.col(entity) == F.col("_cohort"), "left_semi")
    segments = Segments(interval_windows(days, intervals))
    made = _States(days[0])
    distinct = [a for a in aggs if a.distinct and not _by_date(a)]
    columns = {}
    for k, i in enumerate(intervals):
        got = lambda name, k=k: F.col(f"_w{k}")[name]
        for a in aggs:
            for m in a.metrics:
                if not _by_date(a) and not _by_value(a, m) and (a.distinct or m not in TWO):
                    column = got(f"_d{distinct.index(a)}") if a.distinct else made.metric(a, m, got)
                    columns[feature_name(prefix, group, i, a.name, m)] = column.cast(a.cast) if a.cast else column
    # A date that is a column of the events is not the date of the window.
    plain = rows.drop("as_of_date") if "as_of_date" in rows.columns else rows
    values = [[F.expr(q) for q in (a.quantity if isinstance(a.quantity, tuple) else (a.quantity,))] for a in distinct]
    out = window_rows(plain, entity, when, segments, list(made.states.values()), values, own).select("entity_id", "as_of_date", *[c.alias(n) for n, c in columns.items()])
    parts = [_value_metrics(a, plain, entity, when, segments, intervals, prefix, group, own) for a in aggs if not _by_date(a) and any(_by_value(a, m) for m in a.metrics)]
    parts += [_pair_metrics(a, plain, entity, when, segments, intervals, prefix, group, own) for a in aggs if not _by_date(a) and not a.distinct and any(m in TWO for m in a.metrics)]
    if late := [a for a in aggs if _by_date(a)]:
        parts.append(_at_each_date(plain, entity, when, days, intervals, late, prefix, group, cohort))
    for p in parts:
        p = p.withColumnsRenamed({"entity_id": "_e", "as_of_date": "_d"})
        out = out.join(p, [F.col("entity_id").eqNullSafe(F.col("_e")), F.col("as_of_date") == F.col("_d")], "left").drop("_e", "_d")
    named = [(feature_name(prefix, group, i, a.name, m), a.distinct or m == "count") for i in intervals for a in aggs for m in a.metrics]
    return out.select("entity_id", "as_of_date", *[(F.coalesce(F.col(f"`{n}`"), F.lit(0)) if zero else F.col(f"`{n}`")).alias(n) for n, zero in named])


def aggregate(df: DataFrame, groups: Sequence[str], aggs: Sequence[Agg], prefix: str) -> DataFrame:
    """Aggregates by several groups, each joined back to the distinct combinations of the groups."""
    out = df.select(*groups).distinct()
    for g in groups:
        part = df.groupBy(g).agg(*[a.column(m, None).alias(f"{prefix}_{g}_{a.name}_{m}") for a in aggs for m in a.metrics])
        out = out.join(part, g, "left")
    return out


class AggExpr:
    """Arithmetic and comparison of aggregate columns; lists cross, names come from the parts."""

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    @classmethod
    def of(cls, agg: Agg, inside: Column | None = None) -> AggExpr:
        return cls({f"{agg.name}_{m}": agg.column(m, inside) for m in agg.metrics})

    def _with(self, other, sign: str, f) -> AggExpr:
        right = other.columns if isinstance(other, AggExpr) else {str(other): F.lit(other)}
        return AggExpr({f"{a}{sign}{b}": f(x, y) for a, x in self.columns.items() for b, y in right.items()})

    def __add__(self, o): return self._with(o, "+", lambda x, y: x + y)
    def __sub__(self, o): return self._with(o, "-", lambda x, y: x - y)
    def __mul__(self, o): return self._with(o, "*", lambda x, y: x * y)
    def __truediv__(self, o): return self._with(o, "/", lambda x, y: F.try_divide(x.cast("double"), y))
    def __lt__(self, o): return self._with(o, "<", lambda x, y: x < y)
    def __le__(self, o): return self._with(o, "<=", lambda x, y: x <= y)
    def __gt__(self, o): return self._with(o, ">", lambda x, y: x > y)
    def __ge__(self, o): return self._with(o, ">=", lambda x, y: x >= y)
    def equals(self, o): return self._with(o, "=", lambda x, y: x == y)
    def differs(self, o): return self._with(o, "!=", lambda x, y: x != y)
    def both(self, o): return self._with(o, " and ", lambda x, y: x & y)
    def either(self, o): return self._with(o, " or ", lambda x, y: x | y)

    def aliased(self) -> list[Column]:
        return [c.alias(n) for n, c in self.columns.items()]


def source_entity_dates(events: DataFrame, entity: str, when: str, dates: Sequence[date], intervals: Sequence[str]) -> DataFrame:
    """All (entity, date) pairs with an event that counts."""
    return entity_dates(events, entity, when, interval_windows(dates, intervals))


def missing_feature_rows(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """Cohort rows without a feature row."""
    return cohort.select("entity_id", "as_of_date").join(features, ["entity_id", "as_of_date"], "left_anti")


def merge_tables(index: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str] = ("entity_id", "as_of_date")) -> DataFrame:
    """Left joins of every table on the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), tables, index)
