"""Aggregates over many time windows without a row for each event and window.

All window ends cut time into elementary segments. An event lies in one of them, found by a look-up. States that
merge (counts, sums, extremes, moments) are made for each entity and segment first, so the first exchange has no more
rows than there are events. An entity's segments then meet in one row, and its windows are merged in it: between two
dates at which a segment enters or leaves a window nothing changes, so that is done once for each such run of dates.
Counts of a value and moments of pairs are merged over a binary tree with segments as leaves: each window is a union of a few of its nodes,
at most twice the tree's depth.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Window:
    """Events in ``[low, high)`` count for ``day`` under ``slot``; without ``low`` all before ``high``."""

    day: date
    slot: int
    low: datetime | None
    high: datetime


def _moment(t: date) -> datetime:
    return t if isinstance(t, datetime) else datetime.combine(t, time())


class Segments:
    """The segments of a list of windows and the tree over them. It grows with the windows, not with the events."""

    def __init__(self, windows: Sequence[Window]):
        self.windows = [Window(w.day, w.slot, None if w.low is None else _moment(w.low), _moment(w.high)) for w in windows]
        self.cuts = sorted({t for w in self.windows for t in (w.low, w.high) if t is not None})
        self.leaves = 1 << len(self.cuts).bit_length()  # segment k lies behind k cuts
        self.parts: dict[int, list[tuple[date, int]]] = {}
        for w in self.windows:
            for node in self._cover(0 if w.low is None else self._behind(w.low), self._behind(w.high)):
                self.parts.setdefault(node, []).append((w.day, w.slot))
        self.nodes = {k: own for k in range(len(self.cuts) + 1) if (own := [n for n in self._path(k) if n in self.parts])}

    def _behind(self, t: datetime) -> int:
        return bisect_left(self.cuts, t) + 1

    def _path(self, segment: int) -> list[int]:
        node, out = self.leaves + segment, []
        while node:
            out.append(node)
            node >>= 1
        return out

    def _cover(self, low: int, high: int) -> list[int]:
        """Nodes that are the segments from ``low`` up to before ``high`` together."""
        a, b, out = low + self.leaves, high + self.leaves, []
        while a < b:
            if a & 1:
                out.append(a)
                a += 1
            if b & 1:
                b -= 1
                out.append(b)
            a, b = a >> 1, b >> 1
        return out

    def runs(self) -> tuple[list[date], list[tuple[list[int], list[int]]]]:
        """The days, and for each slot by segment: the first day whose window holds it and the first after it that doesn't,
        as places in the list of days. Windows of a slot must be one for each day and not go back in time."""
        days = sorted({w.day for w in self.windows})
        out = []
        for slot in range(max((w.slot for w in self.windows), default=-1) + 1):
            own = sorted((w.day, 0 if w.low is None else self._behind(w.low), self._behind(w.high)) for w in self.windows if w.slot == slot)
            lows, highs = [low for _, low, _ in own], [high for _, _, high in own]
            if [d for d, _, _ in own] != days or lows != sorted(lows) or highs != sorted(highs):
                raise ValueError(f"windows of slot {slot} are not one for each day, in order")
            enter = [bisect_right(highs, k) for k in range(len(self.cuts) + 1)]
            out.append((enter, [max(a, bisect_right(lows, k)) for k, a in enumerate(enter)]))
        return days, out

    def of(self, when: Column) -> Column:
        """The segment of a time: by its day in a table, then past the cuts within that day. Null outside all windows."""
        if not self.cuts:
            return F.lit(None).cast("int")
        t = when.cast("timestamp_ntz")
        first, last = self.cuts[0].date(), self.cuts[-1].date()
        days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
        before = [bisect_left(self.cuts, datetime.combine(d, time())) for d in days]  # cuts before the day begins
        own: dict[int, list[datetime]] = {}
        for c in self.cuts:
            own.setdefault((c.date() - first).days, []).append(c)
        k = F.datediff(t.cast("date"), F.lit(first))
        base = F.when(k < 0, 0).when(k >= len(days), len(self.cuts)).otherwise(F.get(_numbers(before), k))
        if all(len(x) == 1 and x[0].time() == time() for x in own.values()):  # cuts at midnight: one test
            starts = _numbers([int(i in own) for i in range(len(days))])
            inside = F.when(k.between(0, len(days) - 1), F.get(starts, k)).otherwise(0)
        else:
            micros = lambda c: (c - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            texts = F.split(F.lit(";".join(",".join(str(micros(c)) for c in own.get(i, [])) for i in range(len(days)))), ";")
            at = _micros(t)
            inside = F.when(k.between(0, len(days) - 1), F.size(F.filter(F.split(F.get(texts, k), ","), lambda c: (c != "") & (c.cast("long") <= at)))).otherwise(0)
        segment = (base + inside).cast("int")
        used = _numbers([int(i in self.nodes) for i in range(len(self.cuts) + 1)])
        return F.when(when.isNotNull() & (F.get(used, segment) == 1), segment)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """``_seg, _nodes``: the nodes above a segment that some window is made of."""
        return spark.createDataFrame([(k, v) for k, v in self.nodes.items()], "_seg int, _nodes array<int>")

    def window_table(self, spark: SparkSession) -> DataFrame:
        """``_node, _windows``: the windows that a node is part of."""
        return spark.createDataFrame([(k, v) for k, v in self.parts.items()], "_node int, _windows array<struct<as_of_date:date,_slot:int>>")


def _numbers(values: Sequence[int]) -> Column:
    """A constant array; the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _micros(t: Column) -> Column:
    """Microseconds of a time without zone since 1970."""
    days = F.datediff(t.cast("date"), F.lit(date(1970, 1, 1))).cast("long")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.extract(F.lit("SECOND"), t))
    fraction = (F.extract(F.lit("SECOND"), t) * 1_000_000 % 1_000_000).cast("long")
    return (days * 86_400 + seconds) * 1_000_000 + fraction


@dataclass(frozen=True)
class State:
    """Something of a group of events that merges: an aggregate over them, and what two such states are together."""

    name: str
    of: Column
    fold: Callable[[Column, Column], Column]


def plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a | b, a, b)


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a & b, a, b)


def moments(x: Column) -> Column:
    """``n, m, q`` of the values that are not null: number, mean, squared deviations."""
    x = x.cast("double")
    return F.struct(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("q"))


def comoments(y: Column, x: Column) -> Column:
    """``n, my, mx, qy, qx, c`` of the pairs without a null."""
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y.cast("double")), F.when(both, x.cast("double"))
    n, zero = F.count(y), F.lit(0.0)
    value = {"my": F.avg(y), "mx": F.avg(x), "qy": F.var_pop(y) * n, "qx": F.var_pop(x) * n, "c": F.covar_pop(y, x) * n}
    return F.struct(n.alias("n"), *[F.coalesce(v, zero).alias(k) for k, v in value.items()])


def add_moments(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    d = b["m"] - a["m"]
    return F.struct(n.alias("n"), (a["m"] + d * share).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * share).alias("q"))


def merge_moments(states: Column) -> Column:
    """States are few where they meet (tasks), so they are folded one after the other."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    return F.aggregate(F.collect_list(states), zero, add_moments)


def merge_comoments(states: Column) -> Column:
    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        dy, dx = b["my"] - a["my"], b["mx"] - a["mx"]
        new = {"my": a["my"] + dy * share, "mx": a["mx"] + dx * share, "qy": a["qy"] + b["qy"] + dy * dy * a["n"] * share, "qx": a["qx"] + b["qx"] + dx * dx * a["n"] * share, "c": a["c"] + b["c"] + dy * dx * a["n"] * share}
        return F.struct(n.alias("n"), *[v.alias(k) for k, v in new.items()])

    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(k) for k in ("my", "mx", "qy", "qx", "c")])
    return F.aggregate(F.collect_list(states), zero, add)


def window_rows(events: DataFrame, entity: str, when: str, segments: Segments, states: Sequence[State], distinct: Sequence[Sequence[Column]] = (), own: DataFrame | None = None) -> DataFrame:
    """``entity_id, as_of_date`` with events in a window of the date, and for each slot ``_w0``...: a struct of its merged
    states and of ``_d0``...: how many values of ``distinct`` it has (of several columns, nulls included), or null without events.

    One exchange takes a row for each entity and segment after a map-side combine, a second brings those of an entity
    together: they are as many as segments at most, so an entity with a third of all events is no hot task. A value counts
    in the windows that hold one of its segments but not the one before it, so of values an entity has a row for each
    pair of such segments, however many they are. ``own`` has an entity's dates, ``entity_id, _dates``; others play no part.
    """
    days, slots = segments.runs()
    placed = events.withColumn("_seg", segments.of(F.col(when))).filter("_seg is not null").withColumn("_e", F.col(entity))
    made = placed.groupBy("_e", "_seg").agg(*[s.of.alias(s.name) for s in states]).select("_e", F.struct("_seg", *[s.name for s in states]).alias("_s"))
    for i, parts in enumerate(distinct):
        names = [f"_v{k}" for k in range(len(parts))]
        values = placed.select("_e", "_seg", *[c.alias(n) for c, n in zip(parts, names, strict=True)])
        values = (values.filter("_v0 is not null") if len(parts) == 1 else values).distinct()
        w = W.partitionBy("_e", *names).orderBy("_seg")  # as many rows as segments at most
        steps = values.withColumn("_last", F.lag("_seg").over(w)).groupBy("_e", "_seg", "_last").agg(F.count("*").alias("_n"))
        made = made.unionByName(steps.select("_e", F.struct("_seg", "_last", "_n").alias(f"_p{i}")), allowMissingColumns=True)
    whole = made.groupBy(F.col("_e").alias("entity_id")).agg(F.array_sort(F.collect_list("_s")).alias("_s"), *[F.collect_list(f"_p{i}").alias(f"_p{i}") for i in range(len(distinct))])
    kind = whole.schema["_s"].dataType.elementType
    types = {f.name: f.dataType for f in kind.fields}

    def at(k: int, end: int, segment: Column) -> Column:
        return F.get(_numbers(slots[k][end]), segment)

    def inside(k: int, segment: Column, day: Column) -> Column:
        return (at(k, 0, segment) <= day) & (day < at(k, 1, segment))

    def merged(a: Column, b: Column) -> Column:
        # A sum of two decimals is wider than a sum of many.
        typed = lambda s, c: c if isinstance(types[s.name], StructType) else c.cast(types[s.name])
        return F.struct(a["_seg"].alias("_seg"), *[typed(s, s.fold(a[s.name], b[s.name])).alias(s.name) for s in states])

    def window(k: int, day: Column) -> Column:
        found = F.aggregate("_s", F.lit(None).cast(kind), lambda a, s: F.when(~inside(k, s["_seg"], day), a).when(a.isNull(), s).otherwise(merged(a, s)))
        new = lambda p: inside(k, p["_seg"], day) & ~F.coalesce(inside(k, p["_last"], day), F.lit(False))
        counts = [F.aggregate(f"_p{i}", F.lit(0).cast("long"), lambda n, p: n + F.when(new(p), p["_n"]).otherwise(0)).alias(f"_d{i}") for i in range(len(distinct))]
        return F.struct(found.alias("_of"), *counts).alias(f"_w{k}")

    if own is not None:
        whole = whole.join(own, "entity_id")
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda s: F.array(*[at(k, end, s["_seg"]) for k in range(len(slots)) for end in (0, 1)])))))
    spans = whole.withColumn("_ends", ends)
    if not slots:
        return spans.select("entity_id", F.lit(None).cast("date").alias("as_of_date")).limit(0)
    first = F.slice("_ends", 1, F.greatest(F.size("_ends") - 1, F.lit(0)))
    runs = F.transform(first, lambda a, i: F.struct(a.alias("_a"), F.get("_ends", i + 1).alias("_z"), *[window(k, a) for k in range(len(slots))]))
    rows = spans.select("entity_id", *(["_dates"] if own is not None else []), F.explode(runs).alias("_r")).filter(" or ".join(f"_r._w{k}._of is not null" for k in range(len(slots))))
    known = F.split(F.lit(",".join(map(str, days))), ",").cast("array<date>")
    held = F.slice(known, F.col("_r._a") + 1, F.col("_r._z") - F.col("_r._a"))
    parts = [s.name for s in states]
    shown = [F.when(F.col(f"_r._w{k}._of").isNotNull(), F.struct(*[F.col(f"_r._w{k}._of.{n}").alias(n) for n in parts], *[F.col(f"_r._w{k}._d{i}").alias(f"_d{i}") for i in range(len(distinct))])).alias(f"_w{k}") for k in range(len(slots))]
    return rows.select("entity_id", F.explode(held if own is None else F.array_intersect(held, F.col("_dates"))).alias("as_of_date"), *shown)


def window_nodes(events: DataFrame, entity: str, when: str, segments: Segments, of: Column, merge: Callable[[Column], Column], by: Sequence[str] = (), own: DataFrame | None = None) -> DataFrame:
    """``entity_id``, the columns ``by``, ``as_of_date, _slot`` and ``_n``, a state of events: a few rows for each window with events, to be merged.

    One exchange takes a row for each entity, value of ``by`` and segment after a map-side combine; a second brings
    those of an entity and ``by`` together, where all that follows is local. There they are as many as segments
    at most, so an entity with a third of all events is no hot task. ``own`` has an entity's dates, ``entity_id, _dates``;
    others play no part.
    """
    spark, keys = events.sparkSession, ["entity_id", *by]
    made = events.withColumn("_seg", segments.of(F.col(when))).filter("_seg is not null")
    made = made.groupBy(F.col(entity).alias("entity_id"), *by, "_seg").agg(of.alias("_n"))
    # Tables of a config's windows.
    near = made.repartition(*keys).join(F.broadcast(segments.node_table(spark)), "_seg").withColumn("_node", F.explode("_nodes"))
    merged = near.groupBy(*keys, "_node").agg(merge(F.col("_n")).alias("_n"))
    if own is not None:
        merged = merged.join(own, "entity_id")
    windows = F.col("_windows") if own is None else F.filter("_windows", lambda w: F.array_contains(F.col("_dates"), w["as_of_date"]))
    spread = merged.join(F.broadcast(segments.window_table(spark)), "_node").withColumn("_w", F.explode(windows))
    return spread.select(*keys, "_w.as_of_date", "_w._slot", "_n")
