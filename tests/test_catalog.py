"""Every query against its SQL."""

import pytest

from oracle import compare
from sediment.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, name):
    compare(catalog.queries()[name], SQL[name], spark, sf)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


def test_buffer_rotation_against_a_model(spark, sf):
    rows = catalog.queries()["buffer_rotation"](spark, sf).collect()
    by_run = {}
    for r in sorted(rows, key=lambda r: (r.file, r.seq)):
        buffers = by_run.setdefault(r.file, [{}])
        held = buffers[-1]
        total = sum(held.values()) + r["size"] - held.get(r.k, 0)
        if held and total > 2000 and r["size"] > held.get(r.k, -1):
            buffers.append({})
        buffers[-1][r.k] = r["size"]
        assert r.buffer == len(buffers) - 1


def test_key_predicates_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/events.parquet")
    plan.createOrReplaceTempView("e")
    from sediment.operators.changelog import latest_per_key

    for window in (False, True):
        from pyspark.sql import functions as F

        df = latest_per_key(plan.select("user_id", "event_id", "event_type"), ["user_id"], [F.desc("event_id")] if window else ["event_id"], window=window).where("user_id = 7")
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(user_id,7)" in text
        text = df.where("event_type = 'click'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(event_type" not in text


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
