"""Hash trees and co-located tables."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_DIR, rows
from evenkeel.operators import compare as cmp, fingerprint as fp, hash_tree as ht
from evenkeel.plans import derived
from evenkeel.plans.registry import Tables
from evenkeel.sources import writers as wr

SHAPE = ht.Shape(8, 4, 6)


def table(spark, n=40000):
    return spark.range(0, n).select("id", (F.col("id") * 7 % 1000).alias("v"), F.concat(F.lit("t"), "id").alias("text"))


def descent(spark, tmp_path, src, tgt, shape=SHAPE):
    paths = [str(tmp_path / uuid.uuid4().hex) for _ in range(2)]
    for path, df in zip(paths, (src, tgt)):
        ht.build_tree(df, "id", path, None, shape)
    return ht.descend(spark, *paths, shape)


def test_few_nodes_are_read_and_all_gaps_found(spark, tmp_path):
    src = table(spark)
    tgt = src.where("id <> 100 AND id NOT BETWEEN 30000 AND 30007").withColumn("v", F.when(F.col("id") == 20001, -1).otherwise(F.col("v")))
    tgt = tgt.unionByName(spark.createDataFrame([(90001, 5, "new")], "id long, v long, text string"))
    done = descent(spark, tmp_path, src, tgt)
    want = [(96, 103, "COUNT", 8, 7), (20000, 20007, "HASH", 8, 8), (30000, 30007, "COUNT", 8, 0), (90000, 90007, "COUNT", 0, 1)]
    assert rows(done.ranges, "low", "high", "difference", "source_rows", "target_rows") == sorted(want, key=repr)
    assert [level for level, _ in done.nodes_read] == [6, 5, 4, 3, 2, 1, 0]
    # at most four paths of four children on two sides, of some ten thousand leaves
    assert max(n for _, n in done.nodes_read) <= 4 * 4 * 2 and sum(n for _, n in done.nodes_read) < 180
    assert rows(ht.rows_in(src, "id", done.ranges, SHAPE), "id") == sorted([(i,) for a in (96, 20000, 30000) for i in range(a, a + 8)], key=repr)


def test_equal_tables_stop_at_the_top(spark, tmp_path):
    done = descent(spark, tmp_path, table(spark, 5000), table(spark, 5000).repartition(3))
    assert done.ranges.isEmpty() and [level for level, _ in done.nodes_read] == [6]
    empty = table(spark, 0)
    assert descent(spark, tmp_path, empty, empty).ranges.isEmpty()
    assert descent(spark, tmp_path, empty, table(spark, 20)).ranges.count() == 3


def test_null_negative_and_extreme_keys(spark, tmp_path):
    keys = [None, None, -1, 0, -(2**63), 2**63 - 1, 7, 8]
    src = spark.createDataFrame([(k, 1) for k in keys], "id long, v int")
    tgt = spark.createDataFrame([(k, 1 if k not in (None, -1) else 2) for k in keys[1:]] + [(9, 1)], "id long, v int")
    done = descent(spark, tmp_path, src, tgt)
    want = [(None, None, "COUNT", 2, 1), (-8, -1, "HASH", 1, 1), (8, 15, "COUNT", 1, 2)]
    assert rows(done.ranges, "low", "high", "difference", "source_rows", "target_rows") == sorted(want, key=repr)
    assert rows(ht.rows_in(src, "id", done.ranges, SHAPE), "id") == sorted([(None,), (None,), (-1,), (8,)], key=repr)
    assert descent(spark, tmp_path, src, src).ranges.isEmpty()


def test_colocated_tables_compare_without_a_shuffle(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    src, tgt, cols = derived.src_orders(t), derived.tgt_orders(t), derived.ORDER_COLS
    names = [f"side_{uuid.uuid4().hex}" for _ in range(2)]
    try:
        sides = [wr.write_colocated(d, n, "id", str(tmp_path / n), 64, 8) for d, n in zip((src, tgt), names)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        both = cmp.compare_colocated(*sides, "id", "orders", cols)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        plain = cmp.compare_buckets(fp.bucket_hash(src, "orders", "id", cols, 64), fp.bucket_hash(tgt, "orders", "id", cols, 64))
        assert rows(both) == rows(plain) and {r["status"] for r in both.collect()} != {"PASS"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
