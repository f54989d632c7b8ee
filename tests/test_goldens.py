"""Known inputs with known results."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evenkeel.functions import positions as pos
from evenkeel.functions.canon import row_text
from evenkeel.operators import blocking as bl, compare as cmp, fingerprint as fp, gates, mapping as mp, ordered, quality, remediate as rem, slo, telemetry as tm

SUMMARY = "schema_name string, table_name string, row_count long, hash_sum string, updated_count long, deleted_count long, pos int"
SOURCE = [
    ("s", "audit_log", 25200000, "333330999", 50440, 0, 1),
    ("s", "order_items", 5125000, "1234509876", 14425, 85, 2),
    ("s", "orders", 1, "stale", 0, 0, 3),
    ("s", "orders", 1250000, "9876543210", 8421, 120, 4),
    ("s", "payments", 850000, "777777777", 2201, 15, 5),
    ("s", "shipments", 610000, "555550001", 1104, 9, 6),
    ("s", "only_source", 5, "9", 0, 0, 7),
    ("s", "count_only", 10, "1", 2, 2, 8),
]
TARGET = [
    ("s", "audit_log", 25200000, "333330999", 50440, 0, 1),
    ("s", "order_items", 5125000, "1234509876", 14425, 85, 2),
    ("s", "orders", 1249985, "9876541111", 8410, 118, 3),
    ("s", "payments", 850000, "777777700", 2199, 15, 4),
    ("s", "shipments", 610002, "555550001", 1104, 11, 5),
    ("s", "count_only", 11, "1", 2, 2, 6),
]


@pytest.fixture(scope="module")
def report(spark):
    keys = ["schema_name", "table_name"]
    s = cmp.last_row_wins(spark.createDataFrame(SOURCE, SUMMARY), keys, "pos")
    t = cmp.last_row_wins(spark.createDataFrame(TARGET, SUMMARY), keys, "pos")
    return cmp.compare_summaries(s, t)


def test_summary_compare(report):
    got = {r.table_name: (r.severity, r.deltas) for r in report.collect()}
    assert got == {
        "audit_log": ("OK", "{}"),
        "order_items": ("OK", "{}"),
        "orders": ("SEV1", '{"row_count_delta":-15,"update_delta":-11,"delete_delta":-2}'),
        "payments": ("SEV2", '{"update_delta":-2}'),
        "shipments": ("SEV2", '{"row_count_delta":2,"delete_delta":2}'),
        "only_source": ("SEV1", '{"row_count_delta":-5}'),
        "count_only": ("SEV2", '{"row_count_delta":1}'),
    }


def test_gap_classes_in_both_modes(report):
    code = dict(rows(gates.classify_gaps(report), "table_name", "gap_class"))
    documented = dict(rows(gates.classify_gaps(report, "documented"), "table_name", "gap_class"))
    assert code == {
        "audit_log": "OK", "order_items": "OK", "orders": "CLASS-A", "payments": "CLASS-B", "shipments": "CLASS-C", "only_source": "CLASS-A", "count_only": "OK",
    }
    assert documented == {**code, "shipments": "CLASS-A", "count_only": "CLASS-A"}


def test_flags_may_be_text(spark):
    d = spark.createDataFrame([("TRUE", "False", "true", "true")], "count_match string, hash_match string, update_match string, delete_match string")
    assert gates.classify_gaps(d).first().gap_class == "CLASS-B"


def test_canonical_text(spark):
    d = spark.sql("SELECT 1 AS i, CAST(NULL AS STRING) AS n, '  a b ' AS s, 10000000.0D AS d, CAST(1.5 AS DECIMAL(9,2)) AS m, true AS b, TIMESTAMP '2024-01-02 03:04:05.5' AS t, DATE '2024-01-02' AS y")
    assert d.select(row_text(d, with_size=False)).first()[0] == "1|~|a b|10000000.000000|1.50|1|2024-01-02 03:04:05.500000|2024-01-02"


def test_fingerprint_ignores_order_and_sees_copies(spark):
    d = spark.createDataFrame([(i, f"v{i % 7}") for i in range(200)], "id long, v string")
    one = rows(fp.bucket_hash(d, "t", "id", None, 16))
    assert one == rows(fp.bucket_hash(d.orderBy(F.desc("id")).repartition(7), "t", "id", None, 16))
    twice = fp.bucket_hash(d.unionByName(d.where("id < 2")).unionByName(d.where("id < 2")), "t", "id", None, 16)
    status = rows(cmp.compare_buckets(fp.bucket_hash(d, "t", "id", None, 16), twice), "status")
    assert ("FAIL_BUCKET_ROW_COUNT",) in status


def test_ordered_checksum_is_about_order_of_keys_only(spark):
    d = spark.createDataFrame([(i, i * 2) for i in range(50)], "id long, v long")
    a = fp.ordered_checksum(d, "id", ["v"], 10).first().checksum
    assert a == fp.ordered_checksum(d.repartition(5), "id", ["v"], 10).first().checksum
    swapped = d.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    assert a != fp.ordered_checksum(swapped, "id", ["v"], 10).first().checksum


def test_row_diff_with_nulls_and_copies(spark):
    schema = "id long, a string, b string"
    src = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "a", "b"), (4, "q", "q"), (5, "s", "s")], schema)
    tgt = spark.createDataFrame([(1, "x", None), (2, "a", None), (3, "a", "c"), (5, "s", "s"), (5, "s", "s"), (6, "n", "n")], schema)
    assert rows(cmp.row_diff(src, tgt, ["id"], ["a", "b"])) == [(1, "changed", "a,b"), (3, "changed", "b"), (4, "missing", ""), (6, "extra", "")]


def test_repair_makes_compare_clean(spark):
    schema = "id long, a string"
    src = spark.createDataFrame([(i, f"v{i}") for i in range(40)], schema)
    tgt = spark.createDataFrame([(i, "old" if i % 9 == 0 else f"v{i}") for i in range(5, 50)], schema)
    keys = rem.gap_keys(src, tgt, "id", ["a"])
    fixed = rem.remediate(tgt, src, keys, "id")
    assert cmp.row_diff(src, fixed, ["id"], ["a"]).count() == 0
    only = keys.where("repair = 'INSERT'")
    part = rem.remediate(tgt, src, only, "id")
    assert rows(cmp.row_diff(tgt, part, ["id"], ["a"]), "kind") == [("extra",)] * 5


def test_result_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(cmp.result_diff(a, b)) == [(1, "SOURCE", 1), (2, "SOURCE", 1), (3, "TARGET", 1)]


def test_blocking_tree_long_chain_fan_and_cycle(spark):
    chain = [("s", i, i + 1) for i in range(100)]
    fan = [("s", 1000 + i, 50) for i in range(200)]
    cycle = [("s", 5000, 5001), ("s", 5001, 5002), ("s", 5002, 5000), ("s", 5003, 5000)]
    edges = spark.createDataFrame([*chain, *fan, *cycle, ("t", 1, 2)], "snap string, blocked long, blocker long")
    tree = {(r.snap, r.session): r for r in bl.blocking_tree(edges, ["snap"], "blocked", "blocker").collect()}
    assert len(tree) == 305
    assert all(tree["s", i].head_blocker == 100 and tree["s", i].depth == 100 - i for i in range(100))
    assert all(tree["s", 1000 + i].head_blocker == 100 and tree["s", 1000 + i].depth == 51 for i in range(200))
    assert all(tree["s", k].deadlocked and tree["s", k].head_blocker is None for k in (5000, 5001, 5002, 5003))
    assert tree["t", 1].head_blocker == 2
    heads = rows(bl.head_blockers(bl.blocking_tree(edges, ["snap"], "blocked", "blocker"), ["snap"]))
    assert heads == [("s", 100, 300, 100), ("t", 2, 1, 1)]


def test_blocking_pairs_match_null_parts(spark):
    locks = spark.createDataFrame(
        [(1, "r", 1, None, True, "X"), (2, "r", 1, None, False, "S"), (3, "r", 1, 7, False, "S"), (1, "r", 1, None, False, "S")],
        "pid long, locktype string, page long, tuple long, granted boolean, mode string",
    )
    assert rows(bl.blocking_pairs(locks, ["locktype", "page", "tuple"]), "blocked_pid", "blocker_pid") == [(2, 1)]


def test_mappings(spark):
    cat = spark.createDataFrame(
        [("APP_SCHEMA", "ORDERS", "ID", "NUMBER"), ("APP_SCHEMA", "AUDIT_X", "ID", "NUMBER"), ("APP_SCHEMA", "AUDITX", "ID", "NUMBER"), ("OTHER", "T", "ID", "NUMBER")],
        "schema_name string, table_name string, column_name string, data_type string",
    )
    R = mp.MappingRule
    out = mp.apply_mappings(cat, [R("include", "APP_SCHEMA"), R("exclude", "APP_SCHEMA", "AUDIT_%"), R("convert-lowercase"), R("rename-schema", value="public")])
    # the underscore of the pattern stands for any one character, so AUDITX goes as well
    assert rows(out, "target_schema", "target_table") == [("public", "orders")]


@pytest.mark.parametrize(
    "source, pg, sp",
    [
        ("NUMBER(9,0)", "integer", "int"), ("NUMBER(10)", "bigint", "bigint"), ("NUMBER(20,0)", "numeric(20,0)", "decimal(20,0)"), ("NUMBER(10,2)", "numeric(10,2)", "decimal(10,2)"),
        ("NUMBER", "numeric", "double"), ("VARCHAR2(30)", "text", "string"), ("DATE", "timestamp", "timestamp"), ("TIMESTAMP WITH TIME ZONE", "timestamp with time zone", "timestamp"),
        ("BLOB", "bytea", "binary"), ("XMLTYPE", None, None),
    ],
)
def test_type_map(spark, source, pg, sp):
    d = spark.createDataFrame([(source,)], "data_type string")
    assert mp.map_types(d, "postgresql").first().target_type == pg
    assert mp.map_types(d, "spark").first().target_type == sp


def test_number_profile(spark):
    d = spark.sql("SELECT 1.25D AS f, 3000000000L AS b, 7 AS i, CAST('99999999999999999999' AS DECIMAL(20,0)) AS w")
    got = {c: mp.profile_number(d, c).first().suggested_type for c in d.columns}
    assert got == {"f": "numeric(38,2)", "b": "bigint", "i": "integer", "w": "numeric(38,0)"}


def test_regression_gate_is_exact_at_the_limit(spark):
    base = spark.createDataFrame([("q0", 1.0), ("q1", 0.8), ("q2", 1.0)], "q string, s double")
    cur = spark.createDataFrame([("q0", 1.1), ("q1", 0.9), ("q2", 1.1000001)], "q string, s double")
    assert rows(slo.perf_gate(base, cur, "q", "s"), "q", "status") == [("q0", "PASS"), ("q1", "FAIL"), ("q2", "PASS")]
    worse = spark.createDataFrame([("q0", 1.100001)], "q string, s double")
    assert slo.perf_gate(base, worse, "q", "s").first().status == "FAIL"


def test_perf_compare_rounds_to_two_digits(spark):
    s = spark.createDataFrame([("top", 234), ("daily", 567), ("zero", 0)], "q string, ms long")
    t = spark.createDataFrame([("top", 198), ("daily", 512), ("zero", 9)], "q string, ms long")
    assert rows(tm.perf_compare(s, t, "q", "ms"), "q", "delta_pct") == [("daily", -9.7), ("top", -15.38), ("zero", 0.0)]


def test_minute_lag_forms(spark):
    d = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:30' AS a, TIMESTAMP '2024-01-01 01:30:10' AS b")
    r = d.select(pos.lag_minutes(F.col("a"), F.col("b")).alias("x"), pos.lag_minute_boundaries(F.col("a"), F.col("b")).alias("y")).first()
    assert r.x == pytest.approx(89.6667, abs=1e-4) and r.y == 90


def test_log_position_checks(spark):
    good = "0" * 19 + "a"
    d = spark.createDataFrame([(good,), ("0" * 19,), ("g" * 20,), (None,)], "l string")
    assert [r[0] for r in d.select(pos.valid_lsn("l")).collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        pos.lsn_range(d, "l", good, "0" * 20)


def test_precheck_boundary(spark):
    d = spark.createDataFrame([("a",)] * 100 + [("b",)] * 101, "k string")
    assert rows(tm.precheck(d, ["k"], 100)) == [("a", 100, "approve"), ("b", 101, "reject")]


def test_wait_categories(spark):
    names = {"LCK_M_S": "Lock", "LCKX": "Other", "WRITELOG": "IO/Log", "WRITELOGX": "Other", "CXPACKET": "Parallelism", "RESOURCE_SEMAPHORE_QUERY": "Memory", "THREADPOOL": "CPU/Scheduler", "HADR_X": "HADR", "PAGELATCH_UP": "Latch", "PAGEIOLATCH_UP": "IO/Log"}
    d = spark.createDataFrame([(n,) for n in names], "w string")
    assert dict(rows(d.select("w", tm.wait_category("w").alias("c")))) == names


def test_statement_scores(spark):
    data = [
        ("DELETE FROM t", 100, "CRITICAL", "BLOCK"), ("delete from t where a = 1", 0, "LOW", "ALLOW"), ("UPDATE t SET a = 1", 100, "CRITICAL", "BLOCK"), ("TRUNCATE TABLE t", 100, "CRITICAL", "BLOCK"),
        ("SELECT 1 FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x)", 20, "HIGH", "ALERT"),
    ]
    d = spark.createDataFrame([(q, False) for q, *_ in data], "q string, ni boolean")
    got = {r.q: (r.risk_score, r.risk_level, r.action_taken) for r in slo.score_statements(d, "q", "ni").collect()}
    assert got == {q: tuple(rest) for q, *rest in data}
    strict = slo.score_statements(d, "q", "ni", "strict").where("risk_level = 'HIGH'").first()
    assert strict.action_taken == "BLOCK"
    loose = slo.score_statements(d, "q", "ni", "permissive").where("risk_level = 'CRITICAL'").first()
    assert loose.action_taken == "LOG"


def test_sequence_gaps(spark):
    d = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 7, 8, 10)], "n long")
    assert rows(ordered.sequence_gaps(d, "n")) == [(4, 6, 3), (9, 9, 1)]


def test_counter_restart(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 8, 2, 2, 9])], "k string, t long, v long")
    assert rows(ordered.snapshot_delta(d, ["k"], ["t"], "v"), "t", "delta") == [(0, None), (1, 3), (2, 2), (3, 0), (4, 7)]


def test_exceptions_expire(spark):
    r = spark.createDataFrame([("a", "SEV1"), ("b", "SEV1"), ("c", "OK")], "t string, severity string")
    e = spark.createDataFrame([("a", "2024-05-01"), ("b", "2024-01-01"), ("c", "2024-05-01")], "t string, expires_on string")
    assert rows(gates.apply_exceptions(r, e, ["t"], F.lit("2024-03-01")), "t", "severity") == [("a", "SEV3"), ("b", "SEV1"), ("c", "OK")]


def test_schema_rows_and_drift(spark):
    old = spark.createDataFrame([], "a int, b string, c double")
    new = spark.createDataFrame([], "a bigint, b int, d date")
    out = quality.schema_drift(quality.schema_rows(old), quality.schema_rows(new))
    assert rows(out, "column_name", "change", "compatible") == [("a", "retyped", True), ("b", "retyped", False), ("c", "removed", False), ("d", "added", True)]


def test_forecast_of_a_straight_line_and_its_trigger(spark):
    d = spark.sql("SELECT CAST(DATE '2024-01-01' + CAST(id AS INT) AS TIMESTAMP) AS ts, CAST(100 + 2 * id AS DECIMAL(18,2)) AS v FROM range(10)")
    out = slo.forecast(d, [], "ts", F.col("v"), (30,))
    r = slo.trigger_days(out, 200.0).first()
    assert (r.slope, r.projected, r.low, r.high) == (2.0, 178.0, 178.0, 178.0)
    assert r.days_to_limit == 41  # the last sample is 118, and (200 - 118) / 2 = 41
    assert slo.trigger_days(slo.forecast(d.withColumn("v", -F.col("v")), [], "ts", F.col("v"), (30,)), 200.0).first().days_to_limit is None


def test_window_alert_duration(spark):
    data = [(m, 120.0 if 3 <= m <= 5 or m == 8 else 50.0) for m in range(10)]
    metrics = spark.createDataFrame(data, "m long, value double").select(F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz").alias("window_start"), F.lit("latency_p95_ms").alias("metric"), "value")
    fired = slo.fired_alerts(slo.evaluate_rules(metrics, slo.ALERT_RULES), [])
    assert rows(fired, "alert", "samples", "duration_s") == [("DatabaseLatencyBreach", 3, 120.0), ("DatabaseLatencyWarning", 3, 120.0)]


def test_fields_never_run_into_each_other(spark):
    """Separators and null tokens inside values make other rows, and other fingerprints."""
    pairs = [("x|y", "z"), ("x", "y|z"), ("~", None), (None, "~"), ("", None), (None, ""), ("1:x", "y"), ("1", "x:y")]
    d = spark.createDataFrame(pairs, "a string, b string")
    assert d.select(row_text(d).alias("t")).distinct().count() == len(pairs)


def test_sparse_keys_end_in_one_small_block(spark):
    from evenkeel.operators.fingerprint import levels_above, ordered_checksum

    assert 1000 ** (levels_above(1000) + 1) > 2**64
    keys = [(i * 922337203685477 - 2**62, "v") for i in range(500)]
    d = spark.createDataFrame(keys, "id long, v string")
    assert ordered_checksum(d, "id").first()["row_count"] == 500


def test_several_blockers_and_cycles(spark):
    from evenkeel.operators.blocking import blocking_tree

    def tree(pairs):
        e = spark.createDataFrame([(1, a, b) for a, b in pairs], "snap int, a int, b int")
        return sorted(tuple(r) for r in blocking_tree(e, ["snap"], "a", "b").select("session", "head_blocker", "depth", "deadlocked").collect())

    assert tree([(10, 20), (10, 30), (20, 40), (30, 40), (50, 10)]) == [(10, 40, 2, False), (20, 40, 1, False), (30, 40, 1, False), (50, 40, 3, False)]
    assert tree([(1, 2), (2, 1), (3, 1)]) == [(1, None, None, True), (2, None, None, True), (3, None, None, True)]
    # 2 waits for itself over 1, and for the running 9 too
    assert tree([(1, 2), (2, 1), (2, 9), (4, 2)]) == [(1, 9, 2, True), (2, 9, 1, True), (4, 9, 2, False)]


def test_tolerance_counts_every_differing_row(spark):
    from evenkeel.operators.reconcile import Scope, reconcile

    base = spark.range(20000).selectExpr("id", "id % 7 AS v", "id % 5 AS stamp", "id % 11 = 0 AS gone")
    changed = base.where("id > 0").withColumn("v", F.when(F.col("id") > 10000, -1).otherwise(F.col("v")))
    swapped = base.where("id >= 40").unionByName(base.where("id < 39").withColumn("id", F.col("id") + 30000))
    few = base.where("id > 0").withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v")))
    later = base.withColumn("stamp", F.col("stamp") + 1)
    targets = {"changed": changed, "swapped": swapped, "few": few, "same": base, "later": later, "rule": later}
    more = {"later": {"updated": "stamp", "deleted": "gone"}, "rule": {"rules": [fp.Rule("total", "stamp", "SUM")]}}
    scopes = [Scope(n, "id", ["id", "v"], 64, critical=False, **more.get(n, {})) for n in targets]
    got = reconcile(scopes, lambda n: base, targets.get)
    assert rows(got, "table_name", "missing", "extra", "changed", "gap_class", "status") == [
        ("changed", 1, 0, 9999, "CLASS-A", "FAIL"),
        ("few", 1, 0, 1, "CLASS-A", "PASS_WITH_TOLERANCE"),
        ("later", 0, 0, 0, "CLASS-C", "FAIL"),
        ("rule", 0, 0, 0, "OK", "FAIL"),
        ("same", 0, 0, 0, "OK", "PASS"),
        ("swapped", 40, 39, 0, "CLASS-A", "FAIL"),
    ]


def test_roles_are_inherited_over_cycles_by_the_shortest_way(spark):
    from evenkeel.operators import quality

    grants = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (5, 5)], "member_role_id long, role_id long")
    got = {(r["member_role_id"], r["role_id"]): (r["depth"], r["path"]) for r in quality.inherited_roles(grants).collect()}
    assert got == {(1, 2): (1, [1, 2]), (1, 3): (1, [1, 3]), (1, 1): (2, [1, 3, 1]), (2, 3): (1, [2, 3]), (2, 1): (2, [2, 3, 1]), (2, 2): (3, [2, 3, 1, 2]), (3, 1): (1, [3, 1]), (3, 2): (2, [3, 1, 2]), (3, 3): (2, [3, 1, 3]), (5, 5): (1, [5, 5])}


def test_hidden_words_of_statements(spark):
    from evenkeel.operators import slo

    texts = {
        "DELETE FROM t -- where": "delete_without_where",
        "delete from t where a = 'x -- y'": "",
        "DELETE FROM t WHERE a = $$ ( $$": "",
        "DELETE FROM t USING (SELECT ((1)) WHERE b) x": "delete_without_where",
        "/* a */ -- b\n DELETE FROM t": "delete_without_where",
        "UPDATE t SET a = \"where\"": "update_without_where",
        "UPDATE t SET a = 'it''s' WHERE b": "",
        "SELECT 'TRUNCATE t'": "",
        "TRUNCATE t": "truncate",
    }
    log = spark.createDataFrame([(k, False) for k in texts], "sql string, no_index boolean")
    assert {r["sql"]: r["violations"] for r in slo.score_statements(log, "sql", "no_index").collect()} == texts


def test_percentiles_from_panes_equal_those_of_rows(spark):
    import random

    import numpy as np

    from evenkeel.operators import slo

    rnd = random.Random(3)
    data = [(rnd.randrange(86400), rnd.choice([1.0, 2.0, 2.0, 5.5, None, rnd.random()]), rnd.random() < 0.2) for _ in range(600)]
    df = spark.createDataFrame(data, "s long, v double, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    one, two = (slo.pane_counts(d, "ts", [], "1 hour", "v", F.col("bad")) for d in (df.where("s % 2 = 0"), df.where("s % 2 = 1")))
    got = {(r["window_start"].hour + 24 * (r["window_start"].day - 1), r["metric"]): r["value"] for r in slo.metrics_of_panes(one.unionByName(two), [], "6 hours", "1 hour").where("window_start >= '1970-01-01'").collect()}
    for h in range(18):
        inside = [(v, b) for s, v, b in data if h * 3600 <= s < (h + 6) * 3600]
        assert got[h, "events"] == len(inside) and abs(got[h, "error_ratio"] - sum(b for _, b in inside) / len(inside)) < 1e-12
        assert abs(got[h, "latency_p95"] - np.quantile([v for v, _ in inside if v is not None], 0.95)) < 2e-6
