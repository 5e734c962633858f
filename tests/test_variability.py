"""Variability of records that fit a task and of those that do not."""

from __future__ import annotations

import math

from beatloom.operators import variability as V
from beatloom.plans import series_queries
from tests.conftest import SF_DIR

ROWS = [(r, float((7 * i * r) % 31) if i % 5 else None, [0.5, -0.5, math.nan, math.inf][i % 4] if r == 3 else i / 8)
        for r in (1, 2, 3) for i in range(40 * r)] + [(4, 1.0, None), (5, None, None), (None, 1.0, 2.0), (None, 2.0, 3.0)]


def _table(df):
    return {(r["record_id"], r["feature"]): tuple(r[s] if r[s] is None else "nan" if math.isnan(r[s]) else round(r[s], 9) for s in V.STATS)
            for r in df.collect()}


def test_records_in_a_task_and_spread_ones_agree(spark):
    df = spark.createDataFrame(ROWS, "record_id int, a double, b double")
    spread = _table(V.variability_long(V.to_long(df, ["record_id"], ["a", "b"]), ["record_id"]))
    assert len(spread) == 7
    for in_task in (0, 50, 100, 1000):
        assert _table(V.variability(df, ["record_id"], ["a", "b"], in_task)) == spread


def test_rows_of_a_record_move_once(spark):
    df = spark.createDataFrame(ROWS, "record_id int, a double, b double").repartition(3)
    plan = V.variability(df, ["record_id"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_the_long_query_moves_rows_once(spark):
    plan = series_queries.variability_long(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
