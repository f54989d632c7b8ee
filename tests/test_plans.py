"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_DIR
from evenkeel.operators import compare as cmp, marts, ordered, replay as rp
from evenkeel.plans import derived
from evenkeel.plans.registry import Tables

# these write tables or run streams while they are built; the data they return is a plain scan
EAGER = re.compile(r"^(s0|s1|k0|c01|c03_replay_stream|c03_envelope|c07_stream|c09|c10|c14_dedupe|c15_alert_stream|c15_stream|c16_stream|l11|w11|q03_hash_tree)")
NAMES = [n for n in entry.queries() if not EAGER.match(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, SF_DIR)
    text = plan(marts.orphans(t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'"), t.customer, "o_custkey", "c_custkey").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_row_diff_moves_hashes_not_rows(spark):
    t = Tables(spark, SF_DIR)
    keys = cmp.differing_keys(derived.src_orders(t), derived.tgt_orders(t), ["id"], ["status", "total_amount"])
    exchange = [x for x in plan(keys).splitlines() if "Exchange hashpartitioning" in x]
    assert exchange and "status" not in "".join(exchange)


def test_hot_key_is_spread(spark):
    """One key with every row still runs in many tasks."""
    df = spark.range(0, 20000, 1, 8).select(F.col("id"), F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7 != 0).alias("ok"))
    beats = ordered.heartbeat(df, "k", ["ts", "id"], "ok")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in beats.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20000 and len(sizes) >= 6 and max(sizes) < 8000


def test_replay_of_a_hot_key_aggregates_before_the_shuffle(spark):
    t = Tables(spark, SF_DIR)
    text = plan(rp.net_changes(derived.changes(t), ["pk"], "seq"))
    assert "partial_max_by" in text


def test_scalar_as_of_is_not_a_join(spark):
    t = Tables(spark, SF_DIR)
    text = plan(marts.recent(t.orders, "o_orderdate", "7 DAYS"))
    assert "Join" not in text and "Subquery" in text
