"""Queries run at the smallest scale against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["matrix_pipeline", "spacetime_aggregate", "protected_as_of", "impute_rules", "impute_part_of_cohort", "evaluate_scores", "impute_null_category", "evaluate_subset", "rank_predictions_random", "evaluate", "disparity_majority", "distance_from_best", "rule_regrets", "crosstabs", "resolve_entities", "upsert", "model_performance", "rule_winners", "run_matrices", "matrix_catalogue", "run_experiment", "rank_distributed", "spacetime_daily", "label_outcomes", "cohort_within", "cohort_active"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    plain = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v).removesuffix(".0") for v in map(_item, r)) for r in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)


def test_sums_at_a_half_do_not_depend_on_their_order(spark, tmp_path):
    """0.1 + 0.7 + 0.7 is below 1.5 in doubles; as whole numbers the sums are 2, -2 and a number beyond 32 bits."""
    from datetime import datetime

    values = [(1, v) for v in (0.1, 0.7, 0.7)] + [(2, v) for v in (0.7, 0.7, 0.1)] + [(3, v) for v in (-0.1, -0.7, -0.7, None)] + [(4, None), (5, 3e9), (5, 0.5)]
    rows = spark.createDataFrame([(i, datetime(2024, 1, 23), u, v) for i, (u, v) in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = [(1, 2), (2, 2), (3, -2), (4, None), (5, 3_000_000_001)]
    got = entry.queries()["cast_aggregate"](spark, str(tmp_path)).collect()
    assert sorted((r.entity_id, r.ev_user_all_whole_sum) for r in got) == want
    assert sorted((r[0], r[2]) for r in con.sql(entry.oracle_sql()["cast_aggregate"]).fetchall()) == want


def _item(v):
    import pandas as pd

    if v is pd.NaT or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, (int, bool)) else v


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
