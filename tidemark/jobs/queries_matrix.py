"""Queries from events to design matrices."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.jobs.fixtures import AS_OF, EVENT_DATES, YEARS, YEARS_SQL, Register, rounded, table
from tidemark.jobs.pipelines import MATRIX_AGGS, MATRIX_INTERVALS, FeatureSpec, MatrixSpec, forward_matrix, run_matrices, training_matrix
from tidemark.operators import entities as E
from tidemark.operators import features as X
from tidemark.operators import impute as I
from tidemark.operators import matrix as M
from tidemark.operators import prep as P
from tidemark.operators.splits import TemporalConfig, chop_time
from tidemark.operators.splits import all_as_of_dates as distinct_dates
from tidemark.sources import tables as S

REGISTER = Register()
KEYS = ["entity_id", "as_of_date"]

CONFIG = TemporalConfig(datetime(1995, 1, 1), datetime(2001, 8, 1), datetime(1996, 1, 1), datetime(2001, 7, 1), "1 year", ("6 months",), ("3 months",), ("2 years",), ("6 months",), ("6 months",), ("6 months",))
SPLITS_SQL = """times AS (
  SELECT (DATE '2001-01-01' - INTERVAL 6 MONTH - to_years(i::INTEGER))::DATE AS split_time FROM range(0, 20) t(i)
  WHERE (DATE '2001-01-01' - INTERVAL 6 MONTH - to_years(i::INTEGER)) >= DATE '1996-07-01'
), plan AS (
  SELECT split_time, 'train' AS matrix_type, '6 months' AS timespan, '6 months' AS frequency, (split_time - to_months((6 + 6 * i)::INTEGER))::DATE AS as_of_date
  FROM times, range(0, 5) r(i) WHERE split_time - to_months((6 + 6 * i)::INTEGER) >= DATE '1996-01-01'
  UNION ALL
  SELECT split_time, 'test', '6 months', '3 months', (split_time + to_months((3 * i)::INTEGER))::DATE FROM times, range(0, 2) r(i))"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


COHORT_SQL = f"""cohort AS (
  SELECT DISTINCT user_id AS entity_id, as_of_date, TRUE AS active FROM events, ({AS_OF}) WHERE ts < as_of_date)"""
LABELS_SQL = f"""labels AS (
  SELECT user_id AS entity_id, as_of_date, '7 days' AS label_timespan, 'outcome' AS label_name, 'binary' AS label_type,
         bool_or(event_type = 'purchase')::INTEGER::BIGINT AS label
  FROM events, ({AS_OF}) WHERE ts >= as_of_date AND ts < as_of_date + INTERVAL 7 DAY GROUP BY user_id, as_of_date)"""


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return E.cohort_from_events(_events(spark, d), "user_id", "ts", EVENT_DATES)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return E.make_labels(_events(spark, d), "user_id", "ts", EVENT_DATES, ["7 days"], F.col("event_type") == "purchase")


@REGISTER(f"WITH {SPLITS_SQL} SELECT split_time, matrix_type, timespan, frequency, as_of_date, count(o_orderkey) AS n_known FROM plan LEFT JOIN orders ON o_orderdate < as_of_date GROUP BY ALL")
def chop_time_plan(spark, d):
    """The plan of matrices, with the number of orders known on each of its dates."""
    plan = chop_time(spark, CONFIG).drop("split")
    days = [r.as_of_date for r in plan.select("as_of_date").distinct().collect()]
    known = X.known_events(_orders(spark, d), "o_orderdate", days, ["all"]).groupBy("as_of_date").agg(F.count("*").alias("n"))
    return plan.join(known, "as_of_date", "left").withColumn("n_known", F.coalesce("n", F.lit(0))).drop("n")


@REGISTER(f"WITH {SPLITS_SQL}, dd AS (SELECT DISTINCT as_of_date, timespan AS label_timespan FROM plan) SELECT as_of_date, label_timespan, count(DISTINCT o_custkey) AS n_entities FROM dd JOIN orders ON o_orderdate < as_of_date GROUP BY ALL")
def all_as_of_dates(spark, d):
    """Distinct dates and timespans of the plan, with the entities known by then."""
    days = distinct_dates(chop_time(spark, CONFIG))
    known = E.cohort_from_events(_orders(spark, d), "o_custkey", "o_orderdate", [r.as_of_date for r in days.collect()])
    return days.join(known.groupBy("as_of_date").agg(F.count("*").alias("n_entities")), "as_of_date")


@REGISTER(f"WITH {SPLITS_SQL} SELECT matrix_type, split_time, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM plan JOIN orders ON o_orderdate < as_of_date AND o_orderdate >= as_of_date - INTERVAL 6 MONTH GROUP BY ALL")
def split_volumes(spark, d):
    """Orders that each matrix of the plan can see."""
    rows = X.known_events(_orders(spark, d), "o_orderdate", [r.as_of_date for r in chop_time(spark, CONFIG).select("as_of_date").distinct().collect()], ["6 months"])
    joined = rows.join(F.broadcast(chop_time(spark, CONFIG)), "as_of_date")  # a plan of dates
    return rounded(joined.groupBy("matrix_type", "split_time").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")), 2)


@REGISTER(f"WITH {COHORT_SQL} SELECT * FROM cohort")
def cohort_from_events(spark, d):
    return _cohort(spark, d)


@REGISTER(f"""SELECT DISTINCT o_custkey AS entity_id, as_of_date, TRUE AS active FROM orders, ({YEARS_SQL})
WHERE o_orderstatus = 'F' AND o_orderdate < as_of_date AND o_orderdate >= as_of_date - INTERVAL 2 YEAR""")
def cohort_within(spark, d):
    """Customers with a finished order in the two years before each date."""
    return E.cohort_from_events(_orders(spark, d), "o_custkey", "o_orderdate", YEARS, F.col("o_orderstatus") == "F", within="2 years")


@REGISTER(f"WITH {LABELS_SQL} SELECT DISTINCT entity_id, as_of_date, TRUE AS active FROM labels")
def cohort_from_labels(spark, d):
    return E.cohort_from_labels(_labels(spark, d))


@REGISTER(f"WITH {COHORT_SQL} SELECT entity_id, as_of_date, active FROM cohort")
def append_missing_dates(spark, d):
    cohort = _cohort(spark, d)
    old = cohort.filter(F.col("as_of_date") < EVENT_DATES[2])
    return E.append_missing_dates(old, cohort, ["as_of_date"])


@REGISTER(f"""SELECT DISTINCT o_custkey AS entity_id, as_of_date, TRUE AS active
FROM (SELECT o_custkey, min(o_orderdate) AS s, CASE WHEN max(o_orderdate) < DATE '2001-01-01' THEN max(o_orderdate) END AS e FROM orders GROUP BY 1), ({YEARS_SQL})
WHERE s <= as_of_date AND (e IS NULL OR as_of_date <= e)""")
def cohort_active(spark, d):
    spans = _orders(spark, d).groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("m")).withColumn("e", F.when(F.col("m") < F.lit(date(2001, 1, 1)), F.col("m")))
    return E.cohort_active(spans, "o_custkey", YEARS, "s", "e")


@REGISTER(f"""WITH {COHORT_SQL} SELECT * FROM cohort c WHERE NOT EXISTS
  (SELECT 1 FROM events WHERE user_id = c.entity_id AND event_type = 'error' AND value > 100 AND ts < c.as_of_date)""")
def cohort_excluding(spark, d):
    bad = _events(spark, d).filter("event_type = 'error' and value > 100")
    return E.cohort_excluding(_cohort(spark, d), bad, "user_id", "ts").select("entity_id", "as_of_date", "active")


@REGISTER(f"""WITH {COHORT_SQL} SELECT DISTINCT c.entity_id, c.as_of_date, TRUE AS active FROM cohort c JOIN
  (SELECT user_id, as_of_date FROM events, ({AS_OF}) WHERE event_type = 'signup' AND ts < as_of_date) s ON s.user_id = c.entity_id AND s.as_of_date = c.as_of_date""")
def subset_entity_dates(spark, d):
    subset = E.cohort_from_events(_events(spark, d), "user_id", "ts", EVENT_DATES, F.col("event_type") == "signup")
    return E.subset_entity_dates(subset, _cohort(spark, d))


@REGISTER(f"WITH {LABELS_SQL} SELECT * FROM labels")
def make_labels(spark, d):
    return rounded(_labels(spark, d))


@REGISTER(f"""SELECT o_custkey AS entity_id, as_of_date, s AS label_timespan, bool_or(o_orderstatus = 'F')::INTEGER::BIGINT AS label
FROM orders, ({YEARS_SQL}), (VALUES ('6 months', INTERVAL 6 MONTH), ('1 year', INTERVAL 1 YEAR)) v(s, i)
WHERE o_orderdate >= as_of_date AND o_orderdate < as_of_date + i GROUP BY ALL""")
def make_labels_timespans(spark, d):
    out = E.make_labels(_orders(spark, d), "o_custkey", "o_orderdate", YEARS, ["6 months", "1 year"], F.col("o_orderstatus") == "F")
    return rounded(out.select(*KEYS, "label_timespan", "label"))


_OUTCOMES = {"any": "bool_or(o_totalprice > 100000)::INTEGER", "every": "bool_and(o_totalprice > 100000)::INTEGER", "count": "count(o_totalprice)", "sum": "round(sum(o_totalprice), 2)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "avg": "round(avg(o_totalprice), 8)"}


@REGISTER(" UNION ALL ".join(f"""SELECT o_custkey AS entity_id, as_of_date, s AS label_timespan, '{how}' AS label_name, '{'binary' if how in ('any', 'every') else 'regression'}' AS label_type, ({value})::DOUBLE AS label
FROM orders, ({YEARS_SQL}), (VALUES ('6 months', INTERVAL 6 MONTH), ('1 year', INTERVAL 1 YEAR)) v(s, i) WHERE o_orderdate >= as_of_date AND o_orderdate < as_of_date + i GROUP BY ALL""" for how, value in _OUTCOMES.items()))
def label_outcomes(spark, d):
    """Labels by every outcome: whether any or every order is large, how many, their sum, mean and extremes; in one pass."""
    price = F.col("o_totalprice")
    outcomes = [(price > 100_000 if how in ("any", "every") else price, how) for how in _OUTCOMES]
    wide = E.label_columns(_orders(spark, d), "o_custkey", "o_orderdate", YEARS, ["6 months", "1 year"], outcomes)
    each = [F.struct(F.lit(how).alias("label_name"), F.lit(E.type_of(how)).alias("label_type"), F.round(F.col(f"_label{i}").cast("double"), 8 if how == "avg" else 2).alias("label")) for i, how in enumerate(_OUTCOMES)]
    return wide.select(*KEYS, "label_timespan", F.explode(F.array(*each)).alias("_l")).select(*KEYS, "label_timespan", "_l.*")


@REGISTER("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return E.duplicate_keys(_orders(spark, d), ["o_custkey", "o_orderpriority"])


@REGISTER(f"""WITH c AS (SELECT DISTINCT o_custkey AS entity_id, as_of_date FROM orders, ({YEARS_SQL}) WHERE o_orderdate < as_of_date)
SELECT c.entity_id, c.as_of_date, o.o_orderpriority, o.o_orderstatus FROM c LEFT JOIN LATERAL
  (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey = c.entity_id AND o_orderdate < c.as_of_date ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON TRUE""")
def protected_as_of(spark, d):
    orders = _orders(spark, d)
    cohort = E.cohort_from_events(orders, "o_custkey", "o_orderdate", YEARS)
    return E.protected_as_of(cohort, orders.withColumnRenamed("o_custkey", "entity_id"), ["o_orderpriority", "o_orderstatus"], "o_orderdate", ["o_orderkey"])


@REGISTER(f"""WITH {COHORT_SQL}, {LABELS_SQL} SELECT coalesce(c.entity_id, l.entity_id) AS entity_id, coalesce(c.as_of_date, l.as_of_date) AS as_of_date,
  CASE WHEN c.entity_id IS NULL THEN 'right' ELSE 'left' END AS only_in
FROM cohort c FULL JOIN (SELECT DISTINCT entity_id, as_of_date FROM labels) l ON c.entity_id = l.entity_id AND c.as_of_date = l.as_of_date WHERE c.entity_id IS NULL OR l.entity_id IS NULL""")
def key_divergence(spark, d):
    return E.key_divergence(_cohort(spark, d), _labels(spark, d), KEYS)


AGGS = [
    X.Agg("n", "*", ("count",)),
    X.Agg("value", "value", ("sum", "avg", "min", "max", "stddev")),
    X.Agg("days", "datediff(as_of_date, ts)", ("min", "max")),
]
INTERVALS = ["3 days", "7 days", "all"]


def _window_sql(select: str, where: str = "TRUE") -> str:
    return f"SELECT user_id AS entity_id, as_of_date, {select} FROM events, ({AS_OF}) WHERE ts < as_of_date AND {where} GROUP BY user_id, as_of_date"


def _agg_sql(i: str, f: str) -> str:
    n = i.replace(" ", "")
    return ", ".join([f'count(*) {f} AS "ev_user_{n}_n_count"'] + [f'round({fn}(value) {f}, 6) AS "ev_user_{n}_value_{m}"' for m, fn in (("sum", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev", "stddev_samp"))] + [f"{m}(date_diff('day', ts::DATE, as_of_date)) {f} AS \"ev_user_{n}_days_{m}\"" for m in ("min", "max")])


@REGISTER(_window_sql(", ".join([_agg_sql("3 days", "FILTER (WHERE ts >= as_of_date - INTERVAL 3 DAY)"), _agg_sql("7 days", "FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY)"), _agg_sql("all", "FILTER (WHERE TRUE)")])))
def spacetime_aggregate(spark, d):
    return rounded(X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, INTERVALS, AGGS, "ev", "user"))


@REGISTER(f"""WITH {COHORT_SQL}, c AS (SELECT * FROM cohort WHERE entity_id % 2 = 0)
SELECT c.entity_id, c.as_of_date, count(*) FILTER (WHERE ts >= c.as_of_date - INTERVAL 3 DAY) AS ev_user_3days_n_count, count(*) AS ev_user_7days_n_count,
  round(sum(value) FILTER (WHERE ts >= c.as_of_date - INTERVAL 3 DAY), 6) AS ev_user_3days_value_sum, round(sum(value), 6) AS ev_user_7days_value_sum
FROM c JOIN events ON user_id = c.entity_id AND ts < c.as_of_date AND ts >= c.as_of_date - INTERVAL 7 DAY AND ts >= TIMESTAMP '2024-01-03' GROUP BY ALL""")
def spacetime_cohort_floor(spark, d):
    aggs = [X.Agg("n", "*", ("count",)), X.Agg("value", "value", ("sum",))]
    cohort = _cohort(spark, d).filter("entity_id % 2 = 0")
    out = X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["3 days", "7 days"], aggs, "ev", "user", cohort, F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz"))
    return rounded(out)


DAILY = [date(1997, 1, 1) + timedelta(days=k) for k in range(400)]
_DAILY_SQL = "SELECT DATE '1997-01-01' + k::INTEGER AS as_of_date FROM range(400) r(k)"
_DAILY_WINDOWS = (("7days", "o_orderdate >= as_of_date - INTERVAL 7 DAY"), ("6months", "o_orderdate >= as_of_date - INTERVAL 6 MONTH"), ("all", "TRUE"))


@REGISTER("SELECT o_custkey AS entity_id, as_of_date, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS od_cust_{n}_n_count, round(sum(o_totalprice) FILTER (WHERE {w}), 2) AS od_cust_{n}_price_sum, max(o_totalprice) FILTER (WHERE {w}) AS od_cust_{n}_price_max, round(stddev_samp(o_totalprice) FILTER (WHERE {w}), 2) AS od_cust_{n}_price_stddev, min(date_diff('day', o_orderdate::DATE, as_of_date)) FILTER (WHERE {w}) AS od_cust_{n}_days_min, count(DISTINCT o_orderpriority) FILTER (WHERE {w}) AS od_cust_{n}_priorities_count" for n, w in _DAILY_WINDOWS) + f" FROM orders, ({_DAILY_SQL}) WHERE o_orderdate < as_of_date GROUP BY ALL")
def spacetime_daily(spark, d):
    """Windows that end on each of 400 days, from one aggregation by segments of time."""
    aggs = [X.Agg("n", "*", ("count",)), X.Agg("price", "o_totalprice", ("sum", "max", "stddev")), X.Agg("days", "datediff(as_of_date, o_orderdate)", ("min",)), X.Agg("priorities", "o_orderpriority", ("count",), distinct=True)]
    return rounded(X.spacetime_aggregate(_orders(spark, d), "o_custkey", "o_orderdate", DAILY, ["7 days", "6 months", "all"], aggs, "od", "cust"), 2)


@REGISTER("""WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)
SELECT k.*, a.li_l_returnflag_price_sum, a.li_l_returnflag_price_avg, b.li_l_linestatus_price_sum, b.li_l_linestatus_price_avg FROM k
LEFT JOIN (SELECT l_returnflag, round(sum(l_extendedprice), 2) AS li_l_returnflag_price_sum, round(avg(l_extendedprice), 2) AS li_l_returnflag_price_avg FROM lineitem GROUP BY 1) a USING (l_returnflag)
LEFT JOIN (SELECT l_linestatus, round(sum(l_extendedprice), 2) AS li_l_linestatus_price_sum, round(avg(l_extendedprice), 2) AS li_l_linestatus_price_avg FROM lineitem GROUP BY 1) b USING (l_linestatus)""")
def aggregate_groups(spark, d):
    return rounded(X.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [X.Agg("price", "l_extendedprice", ("sum", "avg"))], "li"), 2)


@REGISTER(_window_sql("count(DISTINCT event_type) AS ev_user_all_kinds_count, count(DISTINCT (event_type, ts::DATE)) AS ev_user_all_kind_days_count"))
def distinct_counts(spark, d):
    aggs = [X.Agg("kinds", "event_type", ("count",), distinct=True), X.Agg("kind_days", ("event_type", "cast(ts as date)"), ("count",), distinct=True)]
    return X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user")


@REGISTER(_window_sql("""round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS ev_user_all_value_percentile_50,
  (SELECT 1 WHERE FALSE) IS NULL AS ok, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS ev_user_all_value_percentile_90""").replace("(SELECT 1 WHERE FALSE) IS NULL AS ok, ", ""))
def ordered_set_aggregates(spark, d):
    aggs = [X.Agg("value", "value", ("percentile_50", "percentile_90"))]
    return rounded(X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user"))


@REGISTER(f"""WITH c AS (SELECT user_id AS entity_id, as_of_date, event_type, count(*) AS n FROM events, ({AS_OF}) WHERE ts < as_of_date GROUP BY ALL)
SELECT entity_id, as_of_date, event_type AS ev_user_all_kind_mode FROM c QUALIFY row_number() OVER (PARTITION BY entity_id, as_of_date ORDER BY n DESC, event_type) = 1""")
def mode_aggregate(spark, d):
    return X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], [X.Agg("kind", "event_type", ("mode",))], "ev", "user")


_K = "(json_extract_string(props, '$.k'))::DOUBLE"


@REGISTER(_window_sql(f"CASE WHEN count(*) > 1 THEN round(corr(value, {_K}), 6) END AS ev_user_all_vk_corr, CASE WHEN count(*) > 1 THEN round(regr_slope(value, {_K}), 6) END AS ev_user_all_vk_regr_slope"))
def two_argument_aggregates(spark, d):
    aggs = [X.Agg("vk", ("value", "cast(get_json_object(props, '$.k') as double)"), ("corr", "regr_slope"))]
    return rounded(X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user"))


@REGISTER("""SELECT l_returnflag, round(sum(l_extendedprice) / count(l_quantity), 4) AS "price_sum/n_count", round(max(l_extendedprice) - min(l_extendedprice), 4) AS "top_max-low_min",
  sum(l_extendedprice) > count(l_quantity) AS "price_sum>n_count" FROM lineitem GROUP BY 1""")
def aggregate_arithmetic(spark, d):
    price, n = X.AggExpr.of(X.Agg("price", "l_extendedprice", ("sum",))), X.AggExpr.of(X.Agg("n", "l_quantity", ("count",)))
    top, low = X.AggExpr.of(X.Agg("top", "l_extendedprice", ("max",))), X.AggExpr.of(X.Agg("low", "l_extendedprice", ("min",)))
    cols = [c for e in (price / n, top - low, price > n) for c in e.aliased()]
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(*cols), 4)


@REGISTER(_window_sql("round(sum(value::DECIMAL(28, 4)), 0)::BIGINT AS ev_user_all_whole_sum"))
def cast_aggregate(spark, d):
    """Sums as whole numbers. Values are taken with four decimals, so a sum is exact: one that ends in a half goes away from zero in whatever order it is made."""
    aggs = [X.Agg("whole", "cast(value as decimal(28,4))", ("sum",), cast="decimal(18,0)")]
    out = X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user")
    return out.withColumn("ev_user_all_whole_sum", F.col("ev_user_all_whole_sum").cast("long"))


@REGISTER(_window_sql(", ".join(f"sum((value > {v})::INTEGER)::BIGINT AS \"ev_user_all_value_{n}_sum\", max((value > {v})::INTEGER)::BIGINT AS \"ev_user_all_value_{n}_max\"" for v, n in ((10, "low"), (100, "high"))) + ", sum((value IS NULL)::INTEGER)::BIGINT AS ev_user_all_value__NULL_sum, max((value IS NULL)::INTEGER)::BIGINT AS ev_user_all_value__NULL_max"))
def compare_features(spark, d):
    aggs = X.compare("value", ">", [10, 100], ("sum", "max"), names={10: "low", 100: "high"})
    return rounded(X.spacetime_aggregate(_events(spark, d), "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@REGISTER(_window_sql(", ".join([f"sum((event_type = '{t}')::INTEGER)::BIGINT AS ev_user_all_event_type_{t}_sum, round(avg((event_type = '{t}')::INTEGER), 6) AS ev_user_all_event_type_{t}_avg" for t in _TYPES] + ["sum((event_type IS NULL)::INTEGER)::BIGINT AS ev_user_all_event_type__NULL_sum, round(avg((event_type IS NULL)::INTEGER), 6) AS ev_user_all_event_type__NULL_avg"])))
def categorical_features(spark, d):
    events = _events(spark, d)
    aggs = X.categorical("event_type", X.choices_from(events, "event_type"), ("sum", "avg"))
    return rounded(X.spacetime_aggregate(events, "user_id", "ts", EVENT_DATES, ["all"], aggs, "ev", "user"))


@REGISTER(_window_sql(", ".join(f"sum((event_type = '{t}' OR '{t}' = CASE WHEN value > 100 THEN 'big' ELSE 'small' END)::INTEGER)::BIGINT AS ev_user_all_tags_{t}_sum" for t in ("big", "error", "small"))))
def array_categorical_features(spark, d):
    tagged = _events(spark, d).withColumn("tags", F.array("event_type", F.when(F.col("value") > 100, "big").otherwise("small")))
    return X.spacetime_aggregate(tagged, "user_id", "ts", EVENT_DATES, ["all"], X.array_categorical("tags", ["big", "error", "small"], ("sum",)), "ev", "user")


@REGISTER("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def choices_from(spark, d):
    events = _events(spark, d)
    return events.filter(F.col("event_type").isin(X.choices_from(events, "event_type"))).select("event_type").distinct()


@REGISTER(f"SELECT DISTINCT user_id AS entity_id, as_of_date FROM events, ({AS_OF}) WHERE ts < as_of_date AND ts >= as_of_date - INTERVAL 3 DAY")
def source_entity_dates(spark, d):
    return X.source_entity_dates(_events(spark, d), "user_id", "ts", EVENT_DATES, ["3 days"])


_RARE = f"rare AS (SELECT user_id AS entity_id, as_of_date, count(*) AS n, sum(value) AS s, max((event_type = 'error')::INTEGER) AS e FROM events, ({AS_OF}) WHERE ts < as_of_date AND ts >= as_of_date - INTERVAL 1 DAY AND value > 60 GROUP BY ALL)"
_RARE_AGGS = [X.Agg("n", "*", ("count",), rules={"all": "zero_noflag"}), X.Agg("value", "value", ("sum", "avg"), rules={"sum": ("constant", 137), "avg": "mean"}), X.Agg("err", "cast(event_type = 'error' as int)", ("max",), rules={"all": "binary_mode"})]


def _rare(spark, d):
    return X.spacetime_aggregate(_events(spark, d).filter("value > 60"), "user_id", "ts", EVENT_DATES, ["1 day"], _RARE_AGGS, "r", "u")


def _rare_rules():
    return I.resolve_rules("r", "u", ["1 day"], _RARE_AGGS)


@REGISTER(f"WITH {COHORT_SQL}, {_RARE} SELECT c.entity_id, c.as_of_date FROM cohort c ANTI JOIN rare r USING (entity_id, as_of_date)")
def missing_feature_rows(spark, d):
    return X.missing_feature_rows(_cohort(spark, d), _rare(spark, d))


@REGISTER(f"WITH {COHORT_SQL}, {_RARE} SELECT count(*) FILTER (WHERE n IS NULL) AS r_u_1day_n_count, count(*) FILTER (WHERE n IS NULL) AS r_u_1day_value_sum, count(*) FILTER (WHERE n IS NULL) AS r_u_1day_value_avg, count(*) FILTER (WHERE n IS NULL) AS r_u_1day_err_max FROM cohort LEFT JOIN rare USING (entity_id, as_of_date)")
def find_nulls(spark, d):
    return I.find_nulls(_cohort(spark, d), _rare(spark, d))


@REGISTER(f"""WITH {COHORT_SQL}, {_RARE}, m AS (SELECT as_of_date, avg(s / n) AS a, avg(e) AS em FROM rare GROUP BY 1)
SELECT entity_id, as_of_date, coalesce(n, 0) AS r_u_1day_n_count, round(coalesce(s, 137), 6) AS r_u_1day_value_sum, round(coalesce(s / n, a, 0), 6) AS r_u_1day_value_avg,
  coalesce(e, (em > 0.5)::INTEGER, 0)::BIGINT AS r_u_1day_err_max, (n IS NULL)::INTEGER::BIGINT AS r_u_1day_value_imp, (n IS NULL)::INTEGER::BIGINT AS r_u_1day_err_imp
FROM cohort LEFT JOIN rare USING (entity_id, as_of_date) LEFT JOIN m USING (as_of_date)""")
def impute_rules(spark, d):
    return rounded(I.impute(_cohort(spark, d), _rare(spark, d), _rare_rules()))


_HALF_AGGS = [X.Agg("value", "value", ("sum", "avg"), rules={"sum": "zero", "avg": "mean"})]


@REGISTER(f"""WITH h AS (SELECT DISTINCT user_id AS entity_id, as_of_date FROM events, ({AS_OF}) WHERE ts < as_of_date AND event_type = 'purchase' AND as_of_date > DATE '{EVENT_DATES[0]}'), {_RARE},
z AS (SELECT user_id AS entity_id, as_of_date, {', '.join(f"{m}((event_type = 'error')::INTEGER) AS e{k}, {m}((event_type IS NULL)::INTEGER) AS n{k}" for k, m in enumerate(('avg', 'max', 'sum')))} FROM events, ({AS_OF}) WHERE ts < as_of_date AND ts >= as_of_date - INTERVAL 1 DAY AND value > 60 GROUP BY ALL),
j AS (SELECT h.entity_id, h.as_of_date, s, n, e0, e1, e2, n0, n1, n2 FROM h LEFT JOIN rare USING (entity_id, as_of_date) LEFT JOIN z USING (entity_id, as_of_date))
SELECT entity_id, as_of_date, round(coalesce(s, 0), 6) AS c_u_1day_value_sum, round(coalesce(s / n, avg(s / n) OVER d, 0), 6) AS c_u_1day_value_avg, (n IS NULL)::INTEGER::BIGINT AS c_u_1day_value_imp,
  round(coalesce(e0, avg(e0) OVER d, 0), 6) AS c_u_1day_event_type_error_avg, coalesce(n0, 1)::DOUBLE AS c_u_1day_event_type__NULL_avg,
  coalesce(e1, 1)::BIGINT AS c_u_1day_event_type_error_max, coalesce(n1, 1)::BIGINT AS c_u_1day_event_type__NULL_max,
  coalesce(e2, 0)::BIGINT AS c_u_1day_event_type_error_sum, coalesce(n2, 1)::BIGINT AS c_u_1day_event_type__NULL_sum
FROM j WINDOW d AS (PARTITION BY as_of_date)""")
def impute_part_of_cohort(spark, d):
    """Features also of entities and dates outside the cohort; a category under mean, constant and zero has no flag."""
    kinds = X.categorical("event_type", ["error"], ("avg", "max", "sum"), rules={"avg": "mean", "max": ("constant", "error"), "sum": "zero"})
    feats = X.spacetime_aggregate(_events(spark, d).filter("value > 60"), "user_id", "ts", EVENT_DATES, ["1 day"], [*_HALF_AGGS, *kinds], "c", "u")
    buyers = E.cohort_from_events(_events(spark, d).filter("event_type = 'purchase'"), "user_id", "ts", EVENT_DATES)
    return rounded(I.impute(buyers, feats, I.resolve_rules("c", "u", ["1 day"], [*_HALF_AGGS, *kinds]), dates=EVENT_DATES[1:]))


@REGISTER(f"""WITH {COHORT_SQL}, {_RARE}, z AS (SELECT user_id AS entity_id, as_of_date, sum((event_type = 'error')::INTEGER) AS x, sum((event_type IS NULL)::INTEGER) AS nl FROM events, ({AS_OF}) WHERE ts < as_of_date AND ts >= as_of_date - INTERVAL 1 DAY AND value > 60 GROUP BY ALL)
SELECT entity_id, as_of_date, coalesce(x, 0)::BIGINT AS k_u_1day_event_type_error_sum, coalesce(nl, 1)::BIGINT AS k_u_1day_event_type__NULL_sum FROM cohort LEFT JOIN z USING (entity_id, as_of_date)""")
def impute_null_category(spark, d):
    aggs = X.categorical("event_type", ["error"], ("sum",), rules={"all": "null_category"})
    feats = X.spacetime_aggregate(_events(spark, d).filter("value > 60"), "user_id", "ts", EVENT_DATES, ["1 day"], aggs, "k", "u")
    return rounded(I.impute(_cohort(spark, d), feats, I.resolve_rules("k", "u", ["1 day"], aggs)))


@REGISTER(f"""WITH {COHORT_SQL}, {_RARE} SELECT entity_id, as_of_date, n AS r_u_1day_n_count, round(coalesce(s, 137), 6) AS r_u_1day_value_sum, round(s / n, 6) AS r_u_1day_value_avg, e::BIGINT AS r_u_1day_err_max,
  (n IS NULL)::INTEGER::BIGINT AS r_u_1day_value_imp FROM cohort LEFT JOIN rare USING (entity_id, as_of_date)""")
def impute_forced_columns(spark, d):
    return rounded(I.impute(_cohort(spark, d), _rare(spark, d), _rare_rules(), force=["r_u_1day_value_sum"], observed=[]))


@REGISTER(f"""WITH {COHORT_SQL}, {_RARE}, j AS (SELECT n FROM cohort LEFT JOIN rare USING (entity_id, as_of_date) WHERE n IS NULL), c AS (SELECT count(*) AS n FROM j)
SELECT unnest(['r_u_1day_n_count', 'r_u_1day_value_sum', 'r_u_1day_value_avg', 'r_u_1day_err_max']) AS "column", n FROM c WHERE n > 0""")
def null_counts(spark, d):
    return I.null_counts(_cohort(spark, d).select(*KEYS).join(_rare(spark, d), KEYS, "left"))


@REGISTER(f"WITH {COHORT_SQL}, {LABELS_SQL} SELECT c.entity_id, c.as_of_date FROM cohort c SEMI JOIN (SELECT * FROM labels WHERE label IS NOT NULL) l USING (entity_id, as_of_date) WHERE as_of_date IN (DATE '2024-01-15', DATE '2024-01-22')")
def matrix_index(spark, d):
    return M.matrix_index(_cohort(spark, d), _labels(spark, d), EVENT_DATES[1:3], "train", timespan="7 days")


@REGISTER(f"WITH {COHORT_SQL}, {LABELS_SQL} SELECT c.entity_id, c.as_of_date, coalesce(label, 0) AS label FROM cohort c LEFT JOIN labels l USING (entity_id, as_of_date)")
def attach_labels(spark, d):
    return rounded(M.attach_labels(_cohort(spark, d).select(*KEYS), _labels(spark, d), fill=0))


@REGISTER(f"""WITH {COHORT_SQL}, {LABELS_SQL} SELECT entity_id, as_of_date, count(DISTINCT part) AS n_parts, count(*) AS n_rows FROM
  (SELECT entity_id, as_of_date, 0 AS part FROM cohort UNION ALL SELECT entity_id, as_of_date, 1 FROM labels) GROUP BY ALL HAVING count(DISTINCT part) < 2 OR count(*) > 2""")
def key_faults(spark, d):
    return M.key_faults([_cohort(spark, d), _labels(spark, d)])


@REGISTER(f"""WITH {COHORT_SQL}, {_RARE} SELECT entity_id, as_of_date, n::FLOAT::DOUBLE AS r_u_1day_n_count, round(s::FLOAT::DOUBLE, 2) AS r_u_1day_value_sum FROM cohort LEFT JOIN rare USING (entity_id, as_of_date)""")
def align_and_downcast(spark, d):
    m = M.downcast(_cohort(spark, d).select(*KEYS).join(_rare(spark, d).drop("r_u_1day_value_avg", "r_u_1day_err_max"), KEYS, "left"))
    return rounded(M.align_columns(m, ["r_u_1day_value_sum", "r_u_1day_n_count"]), 2)


_FEATS = """feats AS (SELECT user_id AS entity_id, as_of_date, count(*) FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY) AS c7, count(*) AS ca,
  sum(value) FILTER (WHERE ts >= as_of_date - INTERVAL 7 DAY) AS s7, sum(value) AS sa FROM events, (%s) WHERE ts < as_of_date GROUP BY ALL)""" % AS_OF
_MATRIX_SQL = f"""WITH {COHORT_SQL}, {LABELS_SQL}, {_FEATS}, matrix AS (
SELECT entity_id, as_of_date, c7 AS ev_user_7days_n_count, (c7 IS NULL)::INTEGER AS ev_user_7days_n_imp, round(coalesce(s7, 0)::FLOAT::DOUBLE, 1) AS ev_user_7days_value_sum, (s7 IS NULL)::INTEGER AS ev_user_7days_value_imp,
  ca AS ev_user_all_n_count, 0 AS ev_user_all_n_imp, round(sa::FLOAT::DOUBLE, 1) AS ev_user_all_value_sum, 0 AS ev_user_all_value_imp, label
FROM cohort JOIN feats USING (entity_id, as_of_date) JOIN labels USING (entity_id, as_of_date))"""


@REGISTER(_MATRIX_SQL + """ SELECT entity_id, as_of_date, ev_user_7days_n_count::DOUBLE AS ev_user_7days_n_count, ev_user_7days_n_imp::DOUBLE AS ev_user_7days_n_imp, ev_user_7days_value_sum, ev_user_7days_value_imp::DOUBLE AS ev_user_7days_value_imp,
  ev_user_all_n_count::DOUBLE AS ev_user_all_n_count, ev_user_all_n_imp::DOUBLE AS ev_user_all_n_imp, ev_user_all_value_sum, ev_user_all_value_imp::DOUBLE AS ev_user_all_value_imp, label FROM matrix""")
def matrix_pipeline(spark, d):
    """Events to a training matrix in one pass over all dates."""
    return rounded(training_matrix(_events(spark, d), EVENT_DATES), 1)


@REGISTER(_MATRIX_SQL.replace("WITH", "WITH", 1) + " SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(DISTINCT as_of_date) AS n_dates, count(label) AS n_labelled, round(avg(label), 6) AS label_rate FROM matrix")
def matrix_summary(spark, d):
    m = training_matrix(_events(spark, d), EVENT_DATES)
    return rounded(M.matrix_summary(m, {"dates": EVENT_DATES, "intervals": MATRIX_INTERVALS, "features": X.feature_names("ev", "user", MATRIX_INTERVALS, MATRIX_AGGS)}).drop("matrix_uuid"))


@REGISTER(f"""WITH {COHORT_SQL}, {_FEATS} SELECT entity_id, as_of_date, c7::DOUBLE AS ev_user_7days_n_count, (c7 IS NULL)::INTEGER::DOUBLE AS ev_user_7days_n_imp, round(coalesce(s7, 0)::FLOAT::DOUBLE, 1) AS ev_user_7days_value_sum, (s7 IS NULL)::INTEGER::DOUBLE AS ev_user_7days_value_imp,
  ca::DOUBLE AS ev_user_all_n_count, 0.0::DOUBLE AS ev_user_all_n_imp, round(sa::FLOAT::DOUBLE, 1) AS ev_user_all_value_sum, 0.0::DOUBLE AS ev_user_all_value_imp, 0::BIGINT AS label FROM cohort JOIN feats USING (entity_id, as_of_date) WHERE as_of_date = DATE '2024-01-29'""")
def forward_matrix_rows(spark, d):
    return rounded(forward_matrix(_events(spark, d), EVENT_DATES[-1]), 1)


#: Another user's config: customers with a finished order in two years, who will order for much, by two tables of features.
CUSTOMERS = MatrixSpec("o_custkey", "o_orderdate", "o_totalprice", "max", "o_orderstatus = 'F'", "2 years", (
    FeatureSpec("od", "cust", ("6 months", "1 year"), (X.Agg("n", "*", ("count",), rules={"all": "zero"}), X.Agg("price", "o_totalprice", ("sum", "max"), rules={"all": "zero_noflag"}))),
    FeatureSpec("urgent", "cust", ("1 year",), (X.Agg("n", "*", ("count",), rules={"all": "zero_noflag"}),), "o_orderpriority = '1-URGENT'"),
))


def _in(interval: str) -> str:
    return f"FILTER (WHERE o_orderdate >= as_of_date - INTERVAL {interval})"


@REGISTER(f"""WITH {SPLITS_SQL}, dd AS (SELECT DISTINCT as_of_date FROM plan),
c AS (SELECT DISTINCT o_custkey, as_of_date FROM orders, dd WHERE o_orderstatus = 'F' AND o_orderdate < as_of_date AND o_orderdate >= as_of_date - INTERVAL 2 YEAR),
f AS (SELECT o_custkey, as_of_date, count(*) {_in('6 MONTH')} AS n6, count(*) AS n12, sum(o_totalprice) {_in('6 MONTH')} AS s6, sum(o_totalprice) AS s12, max(o_totalprice) {_in('6 MONTH')} AS m6, max(o_totalprice) AS m12,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u12 FROM orders, dd WHERE o_orderdate < as_of_date AND o_orderdate >= as_of_date - INTERVAL 1 YEAR GROUP BY ALL),
y AS (SELECT o_custkey, as_of_date, max(o_totalprice) AS label FROM orders, dd WHERE o_orderdate >= as_of_date AND o_orderdate < as_of_date + INTERVAL 6 MONTH GROUP BY ALL)
SELECT split_time, matrix_type, o_custkey AS entity_id, as_of_date, coalesce(n6, 0)::DOUBLE AS od_cust_6months_n_count, (n6 IS NULL)::INTEGER::DOUBLE AS od_cust_6months_n_imp, coalesce(n12, 0)::DOUBLE AS od_cust_1year_n_count, (n12 IS NULL)::INTEGER::DOUBLE AS od_cust_1year_n_imp,
  coalesce(s6, 0)::FLOAT::DOUBLE AS od_cust_6months_price_sum, coalesce(s12, 0)::FLOAT::DOUBLE AS od_cust_1year_price_sum, coalesce(m6, 0)::FLOAT::DOUBLE AS od_cust_6months_price_max, coalesce(m12, 0)::FLOAT::DOUBLE AS od_cust_1year_price_max, coalesce(u12, 0)::DOUBLE AS urgent_cust_1year_n_count, label
FROM plan JOIN c USING (as_of_date) LEFT JOIN f USING (o_custkey, as_of_date) LEFT JOIN y USING (o_custkey, as_of_date) WHERE matrix_type = 'test' OR label IS NOT NULL""")
def run_matrices_orders(spark, d):
    """The matrices of a config of one's own: another entity, cohort, outcome and features."""
    out = run_matrices(_orders(spark, d), CONFIG, spec=CUSTOMERS).drop("split", "timespan", "frequency")
    return out.select(*[F.col(c).cast("double").alias(c) if c.startswith(("od_", "urgent_")) else c for c in out.columns])


@REGISTER("""SELECT p_partkey, lower(trim(p_name)) AS name, coalesce(nullif(regexp_extract(lower(trim(p_brand)), 'brand#(\\d+)', 1), ''), 'unknown') AS brand, regexp_replace(lower(trim(p_type)), 'small', 'little', 'g') AS kind FROM part""")
def clean_text(spark, d):
    specs = [P.Clean("name", "p_name", required=True), P.Clean("brand", "p_brand", capture=r"brand#(\d+)"), P.Clean("kind", "p_type", replace=("SMALL", "little"))]
    return P.clean_text(table(spark, d, "part"), specs, keep=["p_partkey"])


@REGISTER("""WITH s AS (SELECT p_partkey, p_size::VARCHAR || ' - ' || p_name || '|' || (p_size + 20)::VARCHAR || ' - ' || p_type AS t FROM part), r AS (
  SELECT p_partkey, unnest(string_split(t, '|')) AS x, generate_subscripts(string_split(t, '|'), 1) - 1 AS nth FROM s)
SELECT p_partkey, nth, split_part(x, ' - ', 1) AS code, split_part(x, ' - ', 2) AS what, CASE WHEN split_part(x, ' - ', 1)::INTEGER <= 14 THEN 'critical' WHEN split_part(x, ' - ', 1)::INTEGER <= 29 THEN 'serious' WHEN split_part(x, ' - ', 1)::INTEGER <= 44 THEN 'minor' END AS severity FROM r""")
def explode_delimited(spark, d):
    text = F.concat_ws("|", F.concat_ws(" - ", F.col("p_size").cast("string"), "p_name"), F.concat_ws(" - ", (F.col("p_size") + 20).cast("string"), "p_type"))
    out = P.explode_delimited(table(spark, d, "part").withColumn("t", text), "t", ["p_partkey"], ["code", "what"], code="code", severities=[(14, "critical"), (29, "serious"), (44, "minor")])
    return out.withColumn("nth", F.col("nth").cast("long"))


@REGISTER("""WITH f AS (SELECT o_custkey, o_orderpriority AS priority, o_orderdate AS first_date, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1),
s AS (SELECT o_custkey, o_orderpriority AS priority, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time FROM orders GROUP BY 1, 2)
SELECT o_custkey, priority, o_orderstatus, start_time, end_time, row_number() OVER (ORDER BY start_time, o_custkey, priority) AS entity_id FROM f JOIN s USING (o_custkey, priority)""")
def resolve_entities(spark, d):
    return P.resolve_entities(_orders(spark, d).withColumnRenamed("o_orderpriority", "priority"), ["o_custkey", "priority"], "o_orderdate", ["o_orderstatus"], "o_orderkey")


@REGISTER("""SELECT o_orderkey, o_custkey, c.n, c.first_line FROM orders JOIN (SELECT l_orderkey, count(*) AS n, min((l_linenumber, l_partkey)) AS m, min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey""")
def nest_children(spark, d):
    """Orders with their lines as JSON, read back to counts and the first line of each list."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = P.nest_children(_orders(spark, d).select("o_orderkey", "o_custkey"), lines, ["o_orderkey"], ["l_linenumber", "l_partkey"])
    items = F.from_json("children", "array<struct<l_linenumber:long,l_partkey:long>>")
    return nested.filter("children is not null").select("o_orderkey", "o_custkey", F.size(items).cast("long").alias("n"), items[0]["l_linenumber"].alias("first_line"))


@REGISTER("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, bool_or(l_returnflag IN ('R')) AS has_wanted FROM lineitem GROUP BY 1""")
def json_list_flags(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_returnflag", "l_linenumber"))).alias("j"))
    out = P.json_list_flags(lists, "l_orderkey", "j", "array<struct<l_returnflag:string,l_linenumber:int>>", "l_returnflag", ["R"])
    return out.select("l_orderkey", F.array_join("values", ",").alias("flags"), "has_wanted")


@REGISTER("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'TOTAL' ELSE l_linestatus END AS l_linestatus, count(*) AS n,
  (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_counts(spark, d):
    return P.rollup_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@REGISTER("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, round(avg((event_type = 'error')::INTEGER), 6) AS rate_error FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20""")
def filtered_rates_top(spark, d):
    return rounded(P.filtered_rates(_events(spark, d), "user_id", {"error": F.col("event_type") == "error"}, n=20))


@REGISTER("SELECT l_linenumber::BIGINT AS model_id, max(l_shipdate)::DATE AS newest, count(*) AS n FROM lineitem GROUP BY 1")
def read_source_query(spark, d):
    lines = S.read_source(spark, d, table="lineitem")
    return S.read_source(spark, query="select cast(l_linenumber as long) as model_id, cast(max(l_shipdate) as date) as newest, count(*) as n from {lines} group by 1", lines=lines)


@REGISTER("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def materialize_source(spark, d):
    once = S.materialize(_orders(spark, d).select("o_custkey", "o_totalprice"))
    return rounded(once.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)
