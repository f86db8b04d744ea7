"""Source preparation: text clean-up, splitting, entities, nesting, rollups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.order import number_rows


@dataclass(frozen=True)
class Clean:
    """How to make a column: lower and trim the source, replace case-insensitively, capture by a
    pattern, fill null with ``unknown``; ``required`` drops rows where nothing is left."""

    name: str
    source: str
    replace: tuple[str, str] | None = None
    capture: str | None = None
    fill: str | None = "unknown"
    required: bool = False

    def column(self) -> Column:
        c = F.lower(F.trim(F.col(self.source)))
        if self.replace:
            c = F.regexp_replace(c, f"(?i){self.replace[0]}", self.replace[1])
        if self.capture:
            c = F.nullif(F.regexp_extract(c, self.capture, 1), F.lit(""))
        return c if self.fill is None else F.coalesce(c, F.lit(self.fill))


def clean_text(df: DataFrame, specs: Sequence[Clean], keep: Sequence[str] = ()) -> DataFrame:
    needed = [F.col(s.name).isNotNull() for s in specs if s.required]
    out = df.select(*keep, *[s.column().alias(s.name) for s in specs])
    for n in needed:
        out = out.filter(n)
    return out


def explode_delimited(df: DataFrame, col: str, keep: Sequence[str], fields: Sequence[str], row_sep: str = r"\|", field_sep: str = " - ", code: str | None = None, severities: Sequence[tuple[int, str]] = ()) -> DataFrame:
    """A row per part of a delimited text and a column per field; a numeric code becomes a severity by
    upper bounds. Missing fields are null."""
    parts = df.select(*keep, F.posexplode(F.split(F.regexp_replace(col, "\n", " "), row_sep)).alias("nth", "_part"))
    split = F.split(F.trim("_part"), field_sep)
    out = parts.select(*keep, "nth", *[F.trim(F.get(split, F.lit(i))).alias(f) for i, f in enumerate(fields)])
    if code:
        number = F.expr(f"try_cast(`{code}` as int)")
        bucket = F.lit(None).cast("string")
        for most, name in reversed(sorted(severities)):
            bucket = F.when(number <= most, name).otherwise(bucket)
        out = out.withColumn("severity", bucket)
    return out


def resolve_entities(df: DataFrame, key: Sequence[str], date_col: str, first_cols: Sequence[str], tie: str) -> DataFrame:
    """One row per natural key: values of its first row by date, first and last dates, and a gapless id in
    order of first date and key. Numbering goes by ranges, not in one task."""
    firsts = df.groupBy(*key).agg(F.min(F.struct(date_col, tie, *first_cols)).alias("_f"), F.min(date_col).alias("start_time"), F.max(date_col).alias("end_time"))
    rows = firsts.select(*key, *[F.col("_f")[c].alias(c) for c in first_cols], "start_time", "end_time")
    return number_rows(rows, [F.col("start_time").asc_nulls_last(), *[F.col(k).asc_nulls_first() for k in key]], "entity_id")


def nest_children(parent: DataFrame, child: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "children") -> DataFrame:
    """Parents with their child rows as an ordered JSON list (by the fields); null without any."""
    lists = child.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias(name))
    return parent.join(lists, list(keys), "left")


def json_list_flags(df: DataFrame, key: str, json_col: str, schema: str, field: str, wanted: Sequence[str]) -> DataFrame:
    """From JSON lists: distinct values of a field per key, sorted, and whether any is wanted."""
    items = df.select(key, F.explode(F.from_json(json_col, schema)).alias("_i")).select(key, F.col("_i")[field].alias("_v"))
    return items.groupBy(key).agg(F.array_sort(F.collect_set("_v")).alias("values"), F.bool_or(F.col("_v").isin(list(wanted))).alias("has_wanted"))


def rollup_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts by the columns, with subtotals and a total; ``level`` is 0 for full rows, and rises with
    each column rolled up. Rolled-up columns read ``TOTAL``."""
    named = [F.when(F.grouping(c) == 1, "TOTAL").otherwise(F.col(c)).alias(c) for c in cols]
    return df.rollup(*cols).agg(F.count("*").alias("n"), F.grouping_id(*cols).alias("_g"), *[n.alias(f"_{c}") for n, c in zip(named, cols, strict=True)]).select(*[F.col(f"_{c}").alias(c) for c in cols], "n", F.col("_g").cast("long").alias("level"))


def filtered_rates(df: DataFrame, key: str, predicates: dict[str, Column], n: int | None = None) -> DataFrame:
    """Rows, matching rows and rates per key and predicate; or the first ``n`` keys by rows."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), *[a for name, p in predicates.items() for a in (F.count_if(p).alias(f"n_{name}"), F.avg(F.coalesce(p, F.lit(False)).cast("int")).alias(f"rate_{name}"))])
    return out if n is None else out.orderBy(F.col("n").desc(), key).limit(n)
