"""Round trips of whole tables through every source, sink and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import slo
from evenkeel.plans.change_queries import CHANGES, USERS, replay_sql
from evenkeel.plans.derived import CHANGES_LATE, TGT_ORDERS, changes, changes_late, src_orders, tgt_orders
from evenkeel.plans.registry import Tables, query
from evenkeel.plans.slo_queries import COMPOSED, COMPOSITE, FIRED, RULES, SLIDING
from evenkeel.plans.telemetry_queries import ROUTED, STREAK
from evenkeel.session import cut_lineage, scratch_path
from evenkeel.sources import readers as rd, writers as wr
from evenkeel.streaming import changes as sc, health as sh, positions as ps
from evenkeel.streaming.state import KeyedState

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def ntz(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("s01_read_csv", ORDERS)
def csv_round_trip(t: Tables):
    path = scratch_path(t.spark, "orders-csv")
    t.orders.write.option("header", True).csv(path)
    back = rd.read_csv(t.spark, path)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_totalprice", *ntz("o_orderdate"), "o_orderpriority")


@query("s02_rows_per_status_file", "SELECT o_orderstatus, count(*) AS row_count FROM orders GROUP BY 1")
def csv_folder(t: Tables):
    path = scratch_path(t.spark, "orders-dir")
    t.orders.withColumn("part", F.col("o_orderstatus")).write.option("header", True).partitionBy("part").csv(path)
    files = rd.list_files(t.spark, path, "*.csv").select("path", F.regexp_extract("path", "part=([A-Z])", 1).alias("o_orderstatus"))
    # file names repeat between partition folders, so rows are counted per full path
    return rd.rows_per_file(t.spark, path).join(files, "path").groupBy("o_orderstatus").agg(F.sum("row_count").alias("row_count"))


@query("s03_read_json", "SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(t: Tables):
    path = scratch_path(t.spark, "conversations-json")
    wr.write_json_array(t.conversations, path)
    return rd.read_json(t.spark, path, t.conversations.schema).select("conv_id", "turn", "role", "text")


QUEUE_SCHEMA = "seq long, pk long, op string, ts timestamp_ntz, amount decimal(18,2), kind string"
LINE = "CASE WHEN seq % 150 = 0 THEN '  ' WHEN seq % 100 = 0 THEN substr(j, 1, length(j) - 8) ELSE j END"


def queue_lines(t: Tables):
    return changes(t).select("seq", F.to_json(F.struct("seq", "pk", "op", "ts", "amount", "kind"), wr.FULL_TIMES).alias("j")).select(F.expr(LINE).alias("value"))


GOOD = f"SELECT seq, pk, op, ts, cast(amount AS double) AS amount, kind FROM {CHANGES} WHERE seq % 150 <> 0 AND seq % 100 <> 0"


@query("s04_read_change_queue", GOOD)
def queue(t: Tables):
    path = scratch_path(t.spark, "queue")
    queue_lines(t).write.text(path)
    rows = rd.read_change_queue(t.spark, path, QUEUE_SCHEMA)
    return rows.where("_corrupt IS NULL").select("seq", "pk", "op", "ts", F.col("amount").cast("double").alias("amount"), "kind")


@query("k07_dead_letter", f"SELECT count(*) AS rejected, 'invalid JSON' AS reject_reason FROM {CHANGES} WHERE seq % 150 <> 0 AND seq % 100 = 0")
def dead(t: Tables):
    path, dead_path = scratch_path(t.spark, "queue"), scratch_path(t.spark, "dead")
    queue_lines(t).write.text(path)
    bad = rd.read_change_queue(t.spark, path, QUEUE_SCHEMA).where("_corrupt IS NOT NULL").select("_corrupt")
    wr.write_dead_letter(bad, dead_path, "invalid JSON")
    return t.spark.read.schema("_corrupt string, reject_reason string").json(dead_path).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "s05_read_summary",
    "SELECT 'sales' AS schema_name, 'c' || o_custkey AS table_name, count(*) AS row_count, cast(sum(o_orderkey) AS varchar) AS hash_sum, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE max(o_orderkey) END AS updated_count, min(o_orderkey) AS deleted_count FROM orders GROUP BY o_custkey",
)
def summary_file(t: Tables):
    path = scratch_path(t.spark, "summary")
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"), F.max("o_orderkey").alias("hi"), F.min("o_orderkey").alias("lo"))
    per.selectExpr(
        "'sales' AS schema_name", "concat('c', o_custkey) AS table_name", "concat(n, '.9') AS row_count", "cast(s AS string) AS hash_sum",
        "CASE WHEN o_custkey % 10 = 0 THEN '' ELSE cast(hi AS string) END AS updated_count", "concat(lo, '.0') AS deleted_count", "'2024-01-01T00:00:00Z' AS run_ts",
    ).write.option("header", True).csv(path)
    return rd.read_summary(t.spark, path).drop("run_ts", "pos")


@query("s07_generated_rows", "SELECT i AS id, i * i % 97 AS bucket FROM (SELECT unnest(range(count(*))) AS i FROM orders)")
def generated(t: Tables):
    return rd.generated_rows(t.spark, t.orders.count(), bucket=F.col("id") * F.col("id") % 97)


@query("s08_bronze", "SELECT o_orderkey, 'load-1' AS _load_id, true AS has_file FROM orders")
def raw(t: Tables):
    return rd.bronze(t.orders, "load-1").select("o_orderkey", "_load_id", (F.length("_source_file") > 0).alias("has_file"))


@query("s09_range_partitioned", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def ranged(t: Tables):
    path = scratch_path(t.spark, "orders-by-month")
    wr.write_range_partitioned(t.orders, "o_orderdate", path)
    return wr.read_range(t.spark, path, "1996-03", "1997-02").select("o_orderkey", "o_orderdate")


@query("s11_manifest", "SELECT 'orders' AS table_name, 'OK' AS status, count(*) AS rows FROM orders")
def manifest(t: Tables):
    path = scratch_path(t.spark, "orders-export")
    wr.write_parquet(t.orders, path, rows_per_file=5000)
    made = rd.manifest_with_rows(rd.build_manifest(t.spark, path, "orders", 42), t.spark.read.parquet(path))
    checked = rd.verify_manifest(made, rd.build_manifest(t.spark, path, "orders", 42))
    return checked.join(made.select("chunk_id", "row_count"), "chunk_id").groupBy("table_name", "status").agg(F.sum("row_count").alias("rows"))


@query("s12_read_fleet", "SELECT c_name AS service_name, c_mktsegment AS tier, cast(c_custkey % 60 AS int) AS rpo_minutes, cast(c_custkey % 240 AS int) AS rto_minutes FROM customer")
def fleet(t: Tables):
    path = scratch_path(t.spark, "fleet")
    cols = [c.split()[0] for c in rd.FLEET_SCHEMA.split(", ")]
    made = {"service_name": "c_name", "tier": "c_mktsegment", "rpo_minutes": "c_custkey % 60", "rto_minutes": "c_custkey % 240"}
    t.customer.selectExpr(*[f"{made.get(c, repr(c))} AS {c}" for c in cols]).write.option("header", True).csv(path)
    return rd.read_fleet(t.spark, path).select("service_name", "tier", "rpo_minutes", "rto_minutes")


@query("k01_csv_to_parquet", "SELECT count(*) AS rows_read, count(*) AS rows_written, 0 AS bad_rows FROM lineitem")
def converted(t: Tables):
    source, target = scratch_path(t.spark, "lineitem-csv"), scratch_path(t.spark, "lineitem-parquet")
    t.lineitem.write.option("header", True).csv(source)
    return wr.csv_to_parquet(t.spark, source, target, "zstd", 20000)


@query(
    "s01_late_types",
    "SELECT o_orderkey + CASE WHEN o_orderkey > 3000 THEN 3000000000 ELSE 0 END AS key_id, CASE WHEN o_orderkey > 3000 THEN o_totalprice ELSE floor(o_totalprice) END AS amount FROM orders",
)
def late_types(t: Tables):
    """Keys outgrow an int and amounts get fractions far behind the first rows of the table."""
    path = scratch_path(t.spark, "late-csv")
    late = t.orders.orderBy("o_orderkey").selectExpr(
        "o_orderkey + CASE WHEN o_orderkey > 3000 THEN 3000000000 ELSE 0 END AS key_id",
        "CASE WHEN o_orderkey > 3000 THEN cast(o_totalprice AS string) ELSE cast(floor(o_totalprice) AS string) END AS amount",
    )
    late.write.option("header", True).csv(path)
    return rd.read_csv(t.spark, path).select("key_id", "amount")


@query("k01_bad_values", "SELECT count(*) AS rows_read, count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS rows_written, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS bad_rows FROM orders")
def bad_values(t: Tables):
    source, target, bad = (scratch_path(t.spark, f"bad-{x}") for x in ("csv", "parquet", "rejected"))
    t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE cast(o_totalprice AS string) END AS amount").write.option("header", True).csv(source)
    return wr.csv_to_parquet(t.spark, source, target, schema="o_orderkey long, amount double", quarantine=bad)


@query(
    "s02_convert_folder",
    "SELECT count(*) AS rows_read, count(*) AS rows_written, 0 AS bad_rows, false AS failed FROM region UNION ALL SELECT count(*), count(*), 0, false FROM nation UNION ALL SELECT count(*), count(*), 0, false FROM supplier",
)
def folder_converted(t: Tables):
    source, target = scratch_path(t.spark, "folder-csv"), scratch_path(t.spark, "folder-parquet")
    for part, table in (("a", t.region), ("b", t.nation), ("c", t.supplier)):
        table.coalesce(1).write.option("header", True).csv(f"{source}/{part}")
    done = wr.convert_csv_folder(t.spark, source, target)
    return done.select("rows_read", "rows_written", "bad_rows", F.col("error").isNotNull().alias("failed"))


@query("k01_converted_rows", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem")
def converted_rows(t: Tables):
    source, target = scratch_path(t.spark, "lineitem-csv"), scratch_path(t.spark, "lineitem-parquet")
    t.lineitem.write.option("header", True).csv(source)
    wr.csv_to_parquet(t.spark, source, target)
    return t.spark.read.parquet(target).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", *ntz("l_shipdate"))


REPORT = "SELECT user_id, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN '{}' ELSE '{\"row_count_delta\":' || user_id || '}' END AS deltas FROM events GROUP BY 1"


def report(t: Tables):
    delta = F.to_json(F.struct(F.when(F.expr("user_id % 3 <> 0"), F.col("user_id")).alias("row_count_delta")))
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("deltas", delta)


@query("k02_csv_report", REPORT)
def csv_report(t: Tables):
    path = scratch_path(t.spark, "report-csv")
    wr.write_csv_report(report(t), path, ["user_id", "n", "deltas"])
    return t.spark.read.option("header", True).option("escape", '"').schema("user_id long, n long, deltas string").csv(path)


@query("t04_stable_report_order", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def sorted_report(t: Tables):
    path = scratch_path(t.spark, "report-sorted")
    per = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # a range shuffle sorts: part files are numbered in report order and no task sees the whole report
    wr.write_csv_report(per, path, ["user_id", "n"], order_by=[F.desc("n"), F.asc("user_id")])
    return t.spark.read.option("header", True).schema("user_id long, n long").csv(path)


@query("k03_json_report", REPORT)
def json_report(t: Tables):
    path = scratch_path(t.spark, "report-json")
    wr.write_json_report(report(t), path)
    return t.spark.read.schema("user_id long, n long, deltas string").json(path)


@query("k04_append_changes", f"SELECT seq, pk, op, ts FROM {CHANGES} UNION ALL SELECT seq, pk, op, ts FROM {CHANGES} WHERE op = 'D'")
def appended(t: Tables):
    path = scratch_path(t.spark, "append")
    c = changes(t).select("seq", "pk", "op", "ts")
    wr.append_changes(c, path)
    wr.append_changes(c.where("op = 'D'"), path)
    return t.spark.read.schema("seq long, pk long, op string, ts timestamp_ntz").json(path)


@query("k05_load_replace", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def replaced(t: Tables):
    import uuid

    name = f"evenkeel_load_{uuid.uuid4().hex}"
    path = scratch_path(t.spark, "managed")
    t.spark.sql(f"CREATE TABLE {name} (c_custkey BIGINT, c_name STRING) USING parquet LOCATION '{path}'")
    wr.load_replace(t.customer.select("c_custkey", "c_name"), name)
    wr.load_replace(t.customer.where("c_acctbal > 0").select("c_custkey", "c_name"), name)
    return t.spark.table(name)


@query("k06_save_snapshot", "SELECT 'r1' AS run_id, 'SOURCE' AS role_name, 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'r1', 'TARGET', 'orders', count(*) FROM %s" % TGT_ORDERS)
def snapshots(t: Tables):
    from evenkeel.operators.fingerprint import row_profile

    path = scratch_path(t.spark, "snapshots")
    wr.save_snapshot(row_profile(src_orders(t), "orders", "id"), path, "r1", "SOURCE")
    wr.save_snapshot(row_profile(tgt_orders(t), "orders", "id"), path, "r1", "TARGET")
    wr.save_snapshot(row_profile(src_orders(t), "orders", "id"), path, "r1", "SOURCE")
    return t.spark.read.parquet(path).select("run_id", "role_name", "table_name", "row_count")


@query("k08_retention", "SELECT ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS kept, count(*) AS n FROM events GROUP BY 1")
def retained(t: Tables):
    return wr.split_retention(t.events, "ts").groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("k08_apply_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def survivors(t: Tables):
    return wr.apply_retention(t.events, "ts").select("event_id")


# ---- streams; each has the SQL of its batch form


@query("c01_change_stream", GOOD)
def streamed(t: Tables):
    src, out, bad, ck = (scratch_path(t.spark, n) for n in ("queue", "stream-out", "stream-dead", "ck"))
    queue_lines(t).repartition(8).write.text(src)
    sc.queue_to_table(sc.change_stream(t.spark, src, QUEUE_SCHEMA, 3), out, bad, ck)
    return t.spark.read.parquet(out).select("seq", "pk", "op", "ts", F.col("amount").cast("double").alias("amount"), "kind")


POSITIONS = f"(SELECT seq // 3 AS position, * FROM {CHANGES})"  # three changes a commit


@query("c01_position_source", f"SELECT position, seq, pk, op, ts, cast(amount AS double) AS amount, kind FROM {POSITIONS}")
def polled(t: Tables):
    """The log grows between two runs; the second goes on at the first one's last position."""
    log, out, ck = (scratch_path(t.spark, n) for n in ("log", "polled", "ck"))
    feed = changes(t).withColumn("position", F.expr("seq div 3"))
    last = feed.agg(F.expr("max(position) div 2")).scalar()
    for part in (F.col("position") <= last, F.col("position") > last):
        feed.where(part).repartitionByRange(4, "position").sortWithinPartitions("position").write.mode("append").parquet(log)
        ps.capture(ps.position_stream(t.spark, log, feed.schema, "position", stretches=ps.CATCH_UP), out, ck)
    return t.spark.read.parquet(out).select("position", "seq", "pk", "op", "ts", F.col("amount").cast("double").alias("amount"), "kind")


def streamed_replay(t: Tables):
    ck, st, mk = (scratch_path(t.spark, n) for n in ("ck", "state", "marks"))
    state = KeyedState(t.spark, st, ["pk"], "pk long, amount decimal(18,2), kind string")
    marks = KeyedState(t.spark, mk, ["table"], "table string, last_seq long, last_timestamp timestamp_ntz, rows_applied long")
    stream = sc.table_stream(t.spark, t.path("events"), t.events.schema)
    feed = stream.selectExpr("event_id AS seq", "user_id AS pk", "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op", "ts", "CAST(value AS DECIMAL(18,2)) AS amount", "event_type AS kind", "'users' AS table")
    sc.replay_stream(feed, state, marks, ck)
    return state, marks


EMPTY_USERS = replay_sql("SKIP").replace(USERS, "(SELECT * FROM %s WHERE false)" % USERS)


@query("c03_replay_stream", EMPTY_USERS)
def replay_streamed(t: Tables):
    state, _ = streamed_replay(t)
    return state.latest().select("pk", F.col("amount").cast("double").alias("amount"), "kind")


@query("c07_stream_checkpoint", "SELECT 'users' AS \"table\", max(event_id) AS last_seq, max(ts) AS last_timestamp, count(*) AS rows_applied FROM events")
def stream_marks(t: Tables):
    _, marks = streamed_replay(t)
    return marks.latest()


def streamed_beats(t: Tables):
    out, ck = (scratch_path(t.spark, n) for n in ("beats", "ck"))
    stream = sc.table_stream(t.spark, t.path("events"), t.events.schema).selectExpr("event_id AS id", "ts", "user_id AS target", "(event_type <> 'error') AS ok")
    sh.heartbeat_stream(stream, out, ck)
    return t.spark.read.parquet(out)


@query("c09_heartbeat_stream", f"SELECT id, target, streak, streak >= 3 AS alarm FROM {STREAK}")
def beats(t: Tables):
    return streamed_beats(t).select("id", "target", "streak", "alarm")


@query("c10_failover_pipeline", ROUTED)
def failover(t: Tables):
    return sh.failover_events(streamed_beats(t)).select("id", "target", "kind", "action", "execution")


@query("c14_dedupe_stream", f"SELECT DISTINCT seq, pk FROM {CHANGES_LATE}")
def deduped(t: Tables):
    out, src, ck = (scratch_path(t.spark, n) for n in ("dedupe", "late", "ck"))
    changes_late(t).write.parquet(src)
    stream = sc.table_stream(t.spark, src, t.spark.read.parquet(src).schema)
    unique = sc.dedupe_stream(stream, "ts", ["pk", "seq"], "30 days")
    sc.run_available(unique.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    return t.spark.read.parquet(out).select("seq", "pk")


@query("c15_alert_stream", f"SELECT window_start, 'error_ratio' AS metric, cast(count(*) FILTER (WHERE event_type = 'error') AS double) / count(*) AS value, cast(count(*) FILTER (WHERE event_type = 'error') AS double) / count(*) > 0.25 AS breached FROM {SLIDING} GROUP BY 1")
def alert_stream(t: Tables):
    st, ck = scratch_path(t.spark, "windows"), scratch_path(t.spark, "ck")
    stream = sc.table_stream(t.spark, t.path("events"), t.events.schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    m = slo.window_metrics(stream, "ts", [], "6 hours", "1 hour", {"error_ratio": F.count_if(F.col("event_type") == "error").cast("double") / F.count(F.lit(1))})
    state = KeyedState(t.spark, st, ["window_start", "metric"], "window_start timestamp_ntz, metric string, value double")
    sh.upsert_windows(m, state, ck)
    rules = [slo.AlertRule("ErrorRateBreach", "error_ratio", True, 0.25, 3600)]
    return slo.evaluate_rules(state.latest(), rules).select("window_start", "metric", "value", "breached")


def streamed_metrics(t: Tables):
    """Exact value counts per pane, kept by a stream over several files, as metrics of sliding windows."""
    src, st, ck = (scratch_path(t.spark, n) for n in ("samples", "panes", "ck"))
    at_once = t.spark.sparkContext.defaultParallelism  # files of each of four batches, so that a batch keeps all cores busy
    t.events.select("ts", "value", (F.col("event_type") == "error").alias("bad")).repartition(4 * at_once).write.parquet(src)
    stream = t.spark.readStream.schema(t.spark.read.parquet(src).schema).option("maxFilesPerTrigger", at_once).parquet(src)
    panes = slo.pane_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "365 days"), "ts", [], "1 hour", "value", F.col("bad"))
    state = KeyedState(t.spark, st, ["pane", "value", "bad"], "pane timestamp_ntz, value double, bad boolean, n long")
    sh.upsert_windows(panes, state, ck)
    return cut_lineage(slo.metrics_of_panes(cut_lineage(state.latest()), [], "6 hours", "1 hour"))  # read more than once


@query("c15_stream_fired", FIRED)
def stream_fired(t: Tables):
    return slo.fired_alerts(slo.evaluate_rules(streamed_metrics(t), RULES), [])


@query("c16_stream", COMPOSED)
def stream_composite(t: Tables):
    return slo.composite_alert(streamed_metrics(t), [], COMPOSITE, 3600)


@query("l11_format_totals", "SELECT f.format, n.row_count, n.total FROM (VALUES ('parquet'), ('orc'), ('csv'), ('json')) f(format), (SELECT count(l_extendedprice) AS row_count, cast(sum(cast(l_extendedprice AS decimal(28,6))) AS double) AS total FROM lineitem) n")
def format_totals(t: Tables):
    """Sizes are not asked for, so the texts are written compressed."""
    out = formats(t, {"csv": "gzip", "json": "gzip"})
    return out.select("format", "row_count", F.col("total").cast("double").alias("total"))


@query("l11_format_bench")
def formats(t: Tables, codecs: dict[str, str] | None = None):
    from evenkeel.operators.formats import format_bench

    return format_bench(t.lineitem, scratch_path(t.spark, "formats"), "l_extendedprice", codecs=codecs, keep=False)
