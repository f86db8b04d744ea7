"""Filling what features lack, by rules per metric, with flags for what was filled."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import Agg, feature_name

KEYS = ("entity_id", "as_of_date")
RULES = ("mean", "constant", "zero", "zero_noflag", "null_category", "binary_mode", "error")


def find_nulls(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """One row: for each feature, how many cohort rows lack it."""
    rows = cohort.select(*KEYS).join(features, list(KEYS), "left")
    return rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in features.columns if c not in KEYS])


def resolve_rules(prefix: str, group: str, intervals: Sequence[str], aggs: Sequence[Agg], defaults: dict | None = None) -> dict[str, tuple]:
    """``column: (rule, value, base name, categorical)``: the metric's own rule, else ``all``; the
    quantity's rules come before the defaults. A column without any rule is an error."""
    out = {}
    for i in intervals:
        for a in aggs:
            for m in a.metrics:
                name = feature_name(prefix, group, i, a.name, m)
                rule = next((r[k] for r in (a.rules, defaults or {}) for k in (m, "all") if k in r), None)
                if rule is None:
                    raise ValueError(f"no imputation rule for {name}")
                kind, value = (rule, None) if isinstance(rule, str) else rule
                if kind not in RULES:
                    raise ValueError(f"unknown imputation rule {kind}")
                if kind == "binary_mode" and a.categorical:
                    raise ValueError(f"{name} is a category, which has no binary mode")
                out[name] = (kind, value, name.removesuffix(f"_{m}"), a.categorical)
    return out


def _filled(name: str, rule: tuple) -> Column:
    kind, value, _, is_category = rule
    c, null_column = F.col(f"`{name}`"), "__NULL" in name
    if kind == "error":
        return F.when(c.isNull(), F.raise_error(F.lit(f"{name} has nulls, which its imputation rule forbids"))).otherwise(c)
    if kind == "mean" and is_category and null_column:
        return F.coalesce(c.cast("double"), F.lit(1.0))
    if kind == "mean":
        return F.coalesce(c.cast("double"), F.col(f"`_mean_{name}`"), F.lit(0.0))
    if kind == "binary_mode":
        return F.coalesce(c, F.when(F.col(f"`_mean_{name}`") > 0.5, 1).otherwise(0))
    if kind == "constant":
        return F.coalesce(c, F.lit(int(str(value) in name or null_column) if is_category else value))
    if kind == "zero":
        return F.coalesce(c, F.lit(int(null_column and is_category)))
    if kind == "null_category":
        if not is_category:
            raise ValueError(f"{name} is no category")
        return F.coalesce(c, F.lit(int(null_column)))
    return F.coalesce(c, F.lit(0)) if kind == "zero_noflag" else c


def impute(cohort: DataFrame, features: DataFrame, rules: dict[str, tuple], force: Iterable[str] = (), observed: Iterable[str] | None = None, dates: Iterable[str] | None = None) -> DataFrame:
    """A row for each cohort row (on ``dates``, where given), without nulls, columns sorted by name, and
    flags ``…_imp``. Feature rows outside the cohort play no part, in means neither.

    Columns to fill are all of the rules', or those in ``observed`` (see ``find_nulls``) and
    ``force`` (columns that were filled in training). A flag says whether any metric of a quantity
    and interval was filled by a rule other than ``zero_noflag``; categories
    have none, for their null column says the same. Means are per date over the cohort's rows, and joined
    from a table of one row per date. A null under the rule ``error`` fails the job.
    """
    names = [c for c in features.columns if c not in KEYS]
    todo = [n for n in names if n in rules and (observed is None or n in set(observed) | set(force))]
    members = cohort.select(*KEYS) if dates is None else cohort.select(*KEYS).filter(F.col("as_of_date").cast("date").isin([F.to_date(F.lit(x)) for x in dates]))
    rows = members.join(features, list(KEYS), "left")
    if means := [n for n in todo if rules[n][0] in ("mean", "binary_mode")]:
        # One row per date of a list of dates.
        table = rows.groupBy("as_of_date").agg(*[F.avg(F.col(f"`{n}`")).alias(f"_mean_{n}") for n in means])
        rows = rows.join(F.broadcast(table), "as_of_date", "left")
    flags: dict[str, Column] = {}
    for n in todo:
        kind, _, base, is_category = rules[n]
        if not is_category and kind not in ("zero_noflag", "error"):
            missing = F.col(f"`{n}`").isNull()
            flags[f"{base}_imp"] = flags[f"{base}_imp"] | missing if f"{base}_imp" in flags else missing
    columns = {n: (_filled(n, rules[n]) if n in todo else F.col(f"`{n}`")) for n in names} | {k: v.cast("tinyint") for k, v in flags.items()}
    return rows.select(*KEYS, *[columns[n].alias(n) for n in sorted(columns)])


def error_columns(nulls: DataFrame, rules: dict[str, tuple]) -> list[str]:
    """Columns under the rule ``error`` that have nulls; reads the one row of ``find_nulls``."""
    counts = nulls.first().asDict()
    return [n for n, r in rules.items() if r[0] == "error" and counts.get(n)]


def null_counts(df: DataFrame) -> DataFrame:
    """One row, ``column, n`` each, of the columns that still have nulls; empty when all is filled."""
    names = [c for c in df.columns if c not in KEYS]
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return one.unpivot([], [f"`{c}`" for c in names], "column", "n").filter("n > 0")


def assert_imputed(df: DataFrame) -> DataFrame:
    if bad := [r["column"] for r in null_counts(df).collect()]:
        raise ValueError(f"nulls are left in {', '.join(bad)}")
    return df
