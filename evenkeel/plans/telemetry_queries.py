"""Sessions, waits, locks, statements, jobs and blocking, as read from the events and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import blocking as bl, compare as cmp, jobs as jb, mapping as mp, telemetry as tm
from evenkeel.operators.marts import newest
from evenkeel.plans.derived import HEALTH, JOB_EXECUTIONS, JOBS, health, job_executions, jobs
from evenkeel.plans.registry import Tables, query

WAIT_TYPE = """CASE event_id % 16 WHEN 0 THEN 'LCK_M_X' WHEN 1 THEN 'LCKXM' WHEN 2 THEN 'PAGEIOLATCH_SH' WHEN 3 THEN 'WRITELOG' WHEN 4 THEN 'CXPACKET' WHEN 5 THEN 'CXSYNC_PORT'
 WHEN 6 THEN 'RESOURCE_SEMAPHORE' WHEN 7 THEN 'MEMORY_ALLOCATION_EXT' WHEN 8 THEN 'SOS_SCHEDULER_YIELD' WHEN 9 THEN 'THREADPOOL' WHEN 10 THEN 'HADR_SYNC_COMMIT' WHEN 11 THEN 'PAGELATCH_EX'
 WHEN 12 THEN 'SLEEP_TASK' WHEN 13 THEN 'XE_TIMER_EVENT' WHEN 14 THEN 'IO_COMPLETION' ELSE 'BACKUPIO' END"""
WAITS = f"(SELECT event_id, user_id, ts, value, {WAIT_TYPE} AS wait_type FROM events)"
V = "CAST(value AS DECIMAL(18,2))"


def waits(t: Tables):
    return t.events.selectExpr("event_id", "user_id", "ts", "value", f"{WAIT_TYPE} AS wait_type", f"{V} AS v")


@query("p09_exclude_benign", f"SELECT wait_type, count(*) AS n FROM {WAITS} WHERE wait_type NOT IN ('SLEEP_TASK','XE_TIMER_EVENT') AND wait_type NOT LIKE '%BACKUP%' GROUP BY 1")
def benign(t: Tables):
    return tm.counts_by(tm.exclude_benign(waits(t), "wait_type", like=["%BACKUP%"]), ["wait_type"])


@query(
    "p10_precheck",
    "SELECT hour, n AS sessions, CASE WHEN n > 14 THEN 'reject' ELSE 'approve' END AS decision FROM (SELECT date_trunc('hour', ts)::timestamp AS hour, count(*) n FROM events GROUP BY 1)",
)
def prechecked(t: Tables):
    return tm.precheck(t.events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")), ["hour"], 14)


STREAK = f"""(SELECT id, target, cast(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY target, grp ORDER BY ts, id) AS bigint) AS streak
  FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY ts, id) AS grp FROM {HEALTH}))"""
ROUTED = f"""SELECT id, target, kind, CASE WHEN kind = 'health_threshold_reached' THEN 'prepare_action' ELSE 'no_action' END AS action,
  CASE WHEN kind = 'health_threshold_reached' THEN 'execution_triggered' ELSE 'no_execution' END AS execution
  FROM (SELECT id, target, CASE WHEN streak >= 3 THEN 'health_threshold_reached' WHEN streak > 0 THEN 'health_degraded' ELSE 'healthy' END AS kind FROM {STREAK})"""


@query("p11_route", ROUTED)
def routed(t: Tables):
    from evenkeel.operators.ordered import heartbeat

    h = heartbeat(health(t), "target", ["ts", "id"], "ok")
    kind = F.when(F.col("alarm"), "health_threshold_reached").when(F.col("streak") > 0, "health_degraded").otherwise("healthy")
    return tm.route(h.select("id", "target", kind.alias("kind")), "kind")


@query(
    "p16_wait_category",
    f"""SELECT wait_type, CASE WHEN starts_with(wait_type,'LCK_') THEN 'Lock' WHEN starts_with(wait_type,'PAGEIOLATCH_') OR starts_with(wait_type,'IO_') OR wait_type IN ('WRITELOG','LOGBUFFER') THEN 'IO/Log'
     WHEN starts_with(wait_type,'CX') THEN 'Parallelism' WHEN starts_with(wait_type,'RESOURCE_SEMAPHORE') OR starts_with(wait_type,'MEMORY_') THEN 'Memory' WHEN wait_type IN ('SOS_SCHEDULER_YIELD','THREADPOOL') THEN 'CPU/Scheduler'
     WHEN starts_with(wait_type,'HADR_') THEN 'HADR' WHEN starts_with(wait_type,'PAGELATCH_') THEN 'Latch' ELSE 'Other' END AS wait_category, count(*) AS tasks, cast(sum({V}) AS double) AS wait_s FROM {WAITS} GROUP BY 1, 2""",
)
def categories(t: Tables):
    per = waits(t).groupBy("wait_type").agg(F.count(F.lit(1)).alias("tasks"), F.sum("v").cast("double").alias("wait_s"))
    return per.withColumn("wait_category", tm.wait_category("wait_type"))


STALLS = f"(SELECT l_suppkey AS file_id, sum(cast(l_discount * 1000 AS decimal(18,2))) AS rs, count(*) FILTER (WHERE l_returnflag = 'A') AS r, sum(cast(l_quantity AS decimal(18,2))) AS ws, count(*) FILTER (WHERE l_returnflag = 'R') AS w FROM lineitem GROUP BY 1)"


def stalls(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("file_id")).agg(
        F.sum((F.col("l_discount") * 1000).cast("decimal(18,2)")).alias("stall_read_ms"),
        F.count_if(F.col("l_returnflag") == "A").alias("reads"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("stall_write_ms"),
        F.count_if(F.col("l_returnflag") == "R").alias("writes"),
    )


@query(
    "p17_hot_files",
    f"SELECT file_id, a AS avg_read_stall_ms, b AS avg_write_stall_ms FROM (SELECT file_id, CASE WHEN r = 0 THEN 0 ELSE cast(rs AS double) / r END AS a, CASE WHEN w = 0 THEN 0 ELSE cast(ws AS double) / w END AS b FROM {STALLS}) WHERE a > 80 OR b > 80",
)
def hot(t: Tables):
    return tm.hot_files(stalls(t), 80).select("file_id", "avg_read_stall_ms", "avg_write_stall_ms")


PART_USE = "(SELECT l_partkey, count(*) FILTER (WHERE l_linestatus = 'O') AS live, count(*) FILTER (WHERE l_linestatus = 'F') AS dead, count(*) FILTER (WHERE l_returnflag = 'A') AS hits, count(*) FILTER (WHERE l_returnflag <> 'A') AS reads FROM lineitem GROUP BY 1)"


def part_use(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("live"),
        F.count_if(F.col("l_linestatus") == "F").alias("dead"),
        F.count_if(F.col("l_returnflag") == "A").alias("hits"),
        F.count_if(F.col("l_returnflag") != "A").alias("reads"),
        F.count_if(F.col("l_quantity") > 40).alias("writes"),
    )


@query("p17_bloat_risk", f"SELECT l_partkey, live, dead, dead * 100.0::double / (live + dead) AS dead_pct FROM {PART_USE} WHERE dead > 25 OR dead * 100.0::double / (live + dead) > 55")
def bloat(t: Tables):
    return tm.bloat_risk(part_use(t), 25, 55.0).select("l_partkey", "live", "dead", "dead_pct")


@query("p17_low_hit", f"SELECT l_partkey, hits * 100.0::double / (hits + reads) AS hit_pct FROM {PART_USE} WHERE reads > 15 AND hits * 100.0::double / (hits + reads) < 35")
def low(t: Tables):
    return tm.low_hit(part_use(t), 15, 35.0).select("l_partkey", "hit_pct")


@query("p17_read_heavy", "SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'A') AS reads, count(*) FILTER (WHERE l_quantity > 40) AS writes FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag <> 'A') > 10 * count(*) FILTER (WHERE l_quantity > 40)")
def heavy(t: Tables):
    return tm.read_heavy(part_use(t)).select("l_partkey", "reads", "writes")


@query(
    "p18_improvement_measure",
    """SELECT p_partkey, c * (i / 100.0::double) * (s + n) AS improvement_measure FROM (SELECT l_partkey AS p_partkey, cast(max(l_extendedprice) AS double) AS c, cast(max(l_quantity) AS double) AS i, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
     ORDER BY 2 DESC, 1 LIMIT 25""",
)
def missing_index(t: Tables):
    per = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("avg_total_user_cost"),
        F.max("l_quantity").alias("avg_user_impact"),
        F.count_if(F.col("l_returnflag") == "A").alias("user_seeks"),
        F.count_if(F.col("l_returnflag") == "N").alias("user_scans"),
    )
    return tm.top_k(tm.improvement_measure(per).select("p_partkey", "improvement_measure"), "improvement_measure", 25, ["p_partkey"])


@query(
    "p19_replica_lag",
    "SELECT user_id, event_type, hi - lo AS replication_lag, CASE WHEN hi - lo > 9900 THEN 'LAGGING' ELSE 'OK' END AS lag_state FROM (SELECT user_id, event_type, max(event_id) hi, min(event_id) lo FROM events GROUP BY 1, 2)",
)
def replicas(t: Tables):
    per = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("log_max_index"), F.min("event_id").alias("log_pointer"))
    return tm.replica_lag(per, 9900).select("user_id", "event_type", "replication_lag", "lag_state")


@query(
    "p20_long_running",
    f"SELECT job_execution_id, (epoch_us(m) - epoch_us(start_time)) / 1e6 AS age_seconds FROM {JOB_EXECUTIONS}, (SELECT max(o_orderdate) m FROM orders) WHERE lifecycle = 'InProgress' AND (epoch_us(m) - epoch_us(start_time)) / 1e6 > 86400 * 365",
)
def long_work(t: Tables):
    e = job_executions(t)
    return tm.long_running(e, "start_time", 86400 * 365, newest(e, "start_time"), idle=F.col("lifecycle") != "InProgress").select("job_execution_id", "age_seconds")


XML = """concat('<event timestamp="', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"><data><value><deadlock><process-list>', repeat(concat('<process spid="', user_id, '"/>'), cast(1 + event_id % 3 AS int)),
  '</process-list><resource-list>', repeat('<keylock/>', cast(event_id % 4 AS int)), '</resource-list></deadlock></value></data></event>')"""


@query("p21_deadlock_events", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time_utc, cast(user_id AS int) AS victim_spid, cast(1 + event_id % 3 AS int) AS process_count, cast(event_id % 4 AS int) AS resource_count FROM events")
def deadlocks(t: Tables):
    return tm.deadlock_events(t.events.select(F.expr(XML).alias("xml")), "xml", None)


@query("p22_utilisation", "SELECT user_id, round(a * 100.0::double / b, 2) AS used_pct, CASE WHEN round(a * 100.0::double / b, 2) >= 30 THEN 'ALERT' WHEN round(a * 100.0::double / b, 2) >= 20 THEN 'WARN' ELSE 'OK' END AS state FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') a, count(*) b FROM events GROUP BY 1)")
def used(t: Tables):
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count(F.lit(1)).alias("b"))
    return tm.utilisation(per, "a", "b", 20, 30).select("user_id", "used_pct", "state")


# ---- mapping

CATALOG_EXPR = [
    "CASE p_partkey % 3 WHEN 0 THEN 'APP_SCHEMA' WHEN 1 THEN 'dbo' ELSE 'tmp' END AS schema_name",
    "CASE WHEN p_partkey % 5 = 0 THEN 'AUDIT_' || p_partkey WHEN p_partkey % 7 = 0 THEN 'AUDITED' ELSE 'T_' || upper(p_type) || '_' || p_partkey END AS table_name",
    "CASE p_size % 6 WHEN 0 THEN 'NUMBER(9,0)' WHEN 1 THEN 'NUMBER(18, 0)' WHEN 2 THEN 'NUMBER(12,2)' WHEN 3 THEN 'datetimeoffset' WHEN 4 THEN 'NUMBER' ELSE 'VARCHAR2(' || p_size || ')' END AS data_type",
    "'C' || p_size AS column_name",
    "p_partkey",
]
CATALOG = f"(SELECT {', '.join(CATALOG_EXPR)} FROM part)"


@query(
    "p03_apply_mappings",
    f"""SELECT p_partkey, 'public' AS target_schema, CASE WHEN schema_name = 'APP_SCHEMA' THEN lower(table_name) ELSE table_name END AS target_table, CASE WHEN data_type = 'datetimeoffset' AND schema_name = 'dbo' THEN 'datetime2' ELSE data_type END AS target_type
     FROM {CATALOG} WHERE schema_name IN ('APP_SCHEMA','dbo') AND NOT (schema_name = 'APP_SCHEMA' AND table_name LIKE 'AUDIT_%')""",
)
def mapped(t: Tables):
    rules = [
        mp.MappingRule("include", "APP_SCHEMA"),
        mp.MappingRule("include", "dbo"),
        mp.MappingRule("exclude", "APP_SCHEMA", "AUDIT_%"),
        mp.MappingRule("convert-lowercase", "APP_SCHEMA"),
        mp.MappingRule("rename-schema", value="public"),
        mp.MappingRule("change-data-type", "dbo", value="datetimeoffset->datetime2"),
    ]
    return mp.apply_mappings(t.part.selectExpr(*CATALOG_EXPR), rules).select("p_partkey", "target_schema", "target_table", "target_type")


@query(
    "p04_map_types",
    f"""SELECT p_partkey, data_type, CASE WHEN data_type = 'NUMBER(9,0)' THEN 'integer' WHEN data_type = 'NUMBER(18, 0)' THEN 'bigint' WHEN data_type = 'NUMBER(12,2)' THEN 'numeric(12,2)' WHEN data_type = 'NUMBER' THEN 'numeric'
      WHEN data_type LIKE 'VARCHAR2%' THEN 'text' ELSE '?' END AS target_type FROM {CATALOG}""",
)
def typed(t: Tables):
    return mp.map_types(t.part.selectExpr(*CATALOG_EXPR), "postgresql").select("p_partkey", "data_type", F.coalesce("target_type", F.lit("?")).alias("target_type"))


@query(
    "p04_profile_number",
    """SELECT 'l_quantity' AS column_name, cast(min(l_quantity) AS double) AS min_value, cast(max(l_quantity) AS double) AS max_value, 0 AS max_scale, 'integer' AS suggested_type FROM lineitem
     UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), 2, 'numeric(38,2)' FROM lineitem""",
)
def numbers(t: Tables):
    return mp.profile_number(t.lineitem, "l_quantity").unionByName(mp.profile_number(t.lineitem, "l_extendedprice"))


@query("p01_transform_posts", "SELECT doc_id AS user_id, length(text) AS text_length FROM documents")
def posts(t: Tables):
    return mp.transform_posts(t.documents, "doc_id", "user_id", "text").select("user_id", F.col("text_length").cast("long").alias("text_length"))


SILVER = "(SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 7 THEN '12,5' ELSE cast(o_custkey AS varchar) END AS price FROM orders)"


@query("p02_silver_orders", f"SELECT o_orderkey, cast(price AS double) AS price, false AS quarantined FROM {SILVER} WHERE try_cast(price AS double) IS NOT NULL UNION ALL SELECT o_orderkey, -1, true FROM {SILVER} WHERE try_cast(price AS double) IS NULL")
def silver(t: Tables):
    raw = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 89 = 7 THEN '12,5' ELSE cast(o_custkey AS string) END AS price")
    good, bad = mp.silver_clean(raw, {"price": "double"})
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.select("o_orderkey", F.lit(-1.0).alias("price"), F.lit(True).alias("quarantined")))


@query(
    "s10_flatten_mounts",
    """SELECT c_custkey AS host, x.target AS target, x.u AS used_percent, CASE WHEN x.u >= 75 THEN 'ALERT' WHEN x.u >= 70 THEN 'WARN' ELSE 'OK' END AS state
     FROM customer, LATERAL (VALUES ('/', cast(c_custkey % 101 AS int)), ('/data', cast(c_custkey * 7 % 101 AS int))) x(target, u)""",
)
def mounts(t: Tables):
    text = """concat('{"host":', c_custkey, ',"mounts":[{"target":"/","use_pct":"', c_custkey % 101, '%"},{"target":"/data","use_pct":"', c_custkey * 7 % 101, '%"}]}')"""
    schema = "host long, mounts array<struct<target:string,use_pct:string>>"
    docs = t.customer.select(F.from_json(F.expr(text), schema).alias("d")).select("d.*")
    return mp.flatten_mounts(docs, "mounts").select("host", "target", "used_percent", "state")


# ---- joins


@query("j12_job_history", f"SELECT job_execution_id, job_name, lifecycle, coalesce(date_diff('second', start_time, end_time), -1) AS duration_seconds FROM {JOBS} JOIN {JOB_EXECUTIONS} USING (job_id)")
def history(t: Tables):
    return jb.job_history(jobs(t), job_executions(t)).select("job_execution_id", "job_name", "lifecycle", F.coalesce("duration_seconds", F.lit(-1)).alias("duration_seconds"))


@query("j12_sla_breaches", f"SELECT job_execution_id, date_diff('second', start_time, end_time) AS duration_seconds FROM {JOB_EXECUTIONS} WHERE lifecycle = 'Succeeded' AND date_diff('second', start_time, end_time) > 600")
def breaches(t: Tables):
    return jb.sla_breaches(jb.job_history(jobs(t), job_executions(t))).select("job_execution_id", "duration_seconds")


@query(
    "j13_job_fanout",
    f"""SELECT DISTINCT job_id, job_execution_id, coalesce(s_name, '') AS group_name, coalesce(db, '') AS database_name FROM {JOBS} JOIN {JOB_EXECUTIONS} USING (job_id) LEFT JOIN (SELECT c_custkey, c_custkey // 15 AS g FROM customer WHERE c_custkey % 9 <> 4) ON c_custkey = job_id
     LEFT JOIN supplier ON s_suppkey = g LEFT JOIN (SELECT s_suppkey AS m, unnest(['db0', 'db' || s_nationkey]) AS db FROM supplier WHERE s_suppkey % 7 <> 2) ON m = s_suppkey""",
)
def fanout(t: Tables):
    steps = t.customer.where("c_custkey % 9 <> 4").selectExpr("c_custkey AS job_id", "c_custkey div 15 AS target_group_id")
    groups = t.supplier.selectExpr("s_suppkey AS target_group_id", "s_name AS group_name")
    members = t.supplier.where("s_suppkey % 7 <> 2").selectExpr("s_suppkey AS target_group_id", "explode(array('db0', concat('db', s_nationkey))) AS database_name")
    out = jb.job_fanout(jobs(t), job_executions(t), steps, groups, members)
    return out.select("job_id", "job_execution_id", F.coalesce("group_name", F.lit("")).alias("group_name"), F.coalesce("database_name", F.lit("")).alias("database_name")).distinct()


@query("u04_distinct_rows", f"SELECT DISTINCT job_id, lifecycle FROM {JOB_EXECUTIONS}")
def distinct_rows(t: Tables):
    return job_executions(t).select("job_id", "lifecycle").distinct()


# a lock names one page of eight consecutive events; the tuple is unknown for some locks
LOCK_EXPR = [
    "user_id AS pid",
    "CASE WHEN event_id % 3 = 2 THEN 'tuple' ELSE 'relation' END AS locktype",
    "event_id - event_id % 8 AS page",
    "CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id % 2 END AS tuple",
    "event_id % 4 = 1 AS granted",
    "CASE event_id % 3 WHEN 0 THEN 'ExclusiveLock' WHEN 1 THEN 'ShareLock' ELSE 'RowShareLock' END AS mode",
]


def locks(t: Tables):
    return t.events.selectExpr(*LOCK_EXPR)


LOCKS = f"(SELECT {', '.join(LOCK_EXPR)} FROM events)"


@query(
    "j14_blocking_pairs",
    f"""SELECT DISTINCT w.pid AS blocked_pid, w.mode AS blocked_mode, h.pid AS blocker_pid, h.mode AS blocker_mode, h.locktype, h.page FROM {LOCKS} w JOIN {LOCKS} h ON w.locktype = h.locktype AND w.page = h.page AND w.tuple IS NOT DISTINCT FROM h.tuple
     WHERE NOT w.granted AND h.granted AND w.pid <> h.pid""",
)
def pairs(t: Tables):
    out = bl.blocking_pairs(locks(t), ["locktype", "page", "tuple"])
    return out.select("blocked_pid", "blocked_mode", "blocker_pid", "blocker_mode", "locktype", "page").distinct()


@query("a26_lock_inventory", f"SELECT locktype, mode, granted, count(*) AS lock_count FROM {LOCKS} GROUP BY 1, 2, 3")
def lock_inventory(t: Tables):
    return tm.counts_by(locks(t), ["locktype", "mode", "granted"], "lock_count")


ACTIVITY = "(SELECT event_id AS pid, user_id, [event_id - 1 - user_id % 5, event_id - 10 - user_id % 7] AS blockers FROM events)"


@query(
    "j15_blocking_from_lists",
    f"SELECT b.pid AS blocked_pid, o.pid AS blocker_pid, b.user_id AS blocked_user_id, o.user_id AS blocker_user_id FROM (SELECT pid, user_id, unnest(blockers) AS x FROM {ACTIVITY}) b JOIN {ACTIVITY} o ON o.pid = b.x",
)
def listed(t: Tables):
    activity = t.events.selectExpr("event_id AS pid", "user_id", "array(event_id - 1 - user_id % 5, event_id - 10 - user_id % 7) AS blockers")
    return bl.blocking_from_lists(activity, "pid", "blockers", ["user_id"])


# sessions fall into groups of four, so that some wait for several others and some for each other
EDGE_SQL = """(SELECT DISTINCT snap, blocked, blocker FROM (SELECT date_trunc('day', ts)::timestamp AS snap, user_id % 40 AS blocked, cast(json_extract_string(props, '$.k') AS bigint) % 40 AS blocker FROM events)
  WHERE blocked <> blocker AND blocked % 3 <> 0 AND (blocked + blocker) % 7 = 0)"""


def edges(t: Tables):
    e = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("snap"), F.expr("user_id % 40").alias("blocked"), F.expr("cast(get_json_object(props, '$.k') AS bigint) % 40").alias("blocker"))
    return e.where("blocked <> blocker AND blocked % 3 <> 0 AND (blocked + blocker) % 7 = 0").distinct()


TREE = f"""WITH RECURSIVE e AS (SELECT * FROM {EDGE_SQL}), w AS (SELECT snap, blocked AS session, blocker AS anc, 1 AS depth FROM e UNION
   SELECT w.snap, w.session, e.blocker, w.depth + 1 FROM w JOIN e ON e.snap = w.snap AND e.blocked = w.anc WHERE w.depth < 41),
  heads AS (SELECT snap, session, anc, min(depth) AS depth FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.snap = w.snap AND e.blocked = w.anc) GROUP BY 1, 2, 3),
  circle AS (SELECT DISTINCT snap, session FROM w WHERE session = anc),
  tree AS (SELECT s.snap, s.session, h.anc AS head_blocker, h.depth, c.session IS NOT NULL OR h.anc IS NULL AS deadlocked
    FROM (SELECT DISTINCT snap, blocked AS session FROM e) s LEFT JOIN heads h ON h.snap = s.snap AND h.session = s.session LEFT JOIN circle c ON c.snap = s.snap AND c.session = s.session)"""


@query("w11_blocking_tree", TREE + " SELECT snap, session, coalesce(head_blocker, -1) AS head_blocker, cast(coalesce(depth, -1) AS bigint) AS depth, deadlocked FROM tree")
def tree(t: Tables):
    out = bl.blocking_tree(edges(t), ["snap"], "blocked", "blocker")
    return out.select("snap", "session", F.coalesce("head_blocker", F.lit(-1)).alias("head_blocker"), F.coalesce("depth", F.lit(-1)).alias("depth"), "deadlocked")


@query("w11_head_blockers", TREE + " SELECT snap, head_blocker, count(*) AS victims, cast(max(depth) AS bigint) AS max_depth FROM tree WHERE head_blocker IS NOT NULL GROUP BY 1, 2")
def heads(t: Tables):
    return bl.head_blockers(bl.blocking_tree(edges(t), ["snap"], "blocked", "blocker"), ["snap"])


@query("j16_statement_text", "SELECT e.event_id, coalesce(d.source, '') AS source, coalesce(d.n_chars, -1) AS n_chars FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 9")
def texts(t: Tables):
    stats = t.events.select("event_id", (F.col("user_id") * 9).alias("doc_id"))
    out = tm.with_statement_text(stats, t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    return out.select("event_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query(
    "j17_health_vs_capacity",
    "SELECT cast((SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS bigint) AS aas, cast((SELECT count(*) FROM supplier) AS bigint) AS cpu_count",
)
def capacity(t: Tables):
    from evenkeel.operators.marts import with_as_of

    active = with_as_of(t.events, newest(t.events, "ts")).where("ts >= as_of - INTERVAL 1 DAY").agg(F.count(F.lit(1)).alias("aas"))
    return tm.one_row(active, t.supplier.agg(F.count(F.lit(1)).alias("cpu_count")))


@query(
    "j18_report_row",
    "SELECT (SELECT count(*) FROM events) AS current_connections, (SELECT count(*) FROM events WHERE event_type = 'click') AS active_connections, (SELECT count(*) FROM events WHERE value > 10) AS slow_statements",
)
def report_row(t: Tables):
    return t.events.agg(
        F.count(F.lit(1)).alias("current_connections"), F.count_if(F.col("event_type") == "click").alias("active_connections"), F.count_if(F.col("value") > 10).alias("slow_statements")
    )


@query(
    "j19_multiway_lookup",
    """SELECT n_name, o_orderpriority, count(*) AS line_count, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def lookup(t: Tables):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    return (
        per.join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "o_orderpriority")
        .agg(F.sum("n").alias("line_count"), F.sum("s").cast("double").alias("total"))
    )


@query(
    "j20_perf_compare",
    """SELECT s.user_id, s.ms AS source_ms, t.ms AS target_ms, CASE WHEN s.ms = 0 THEN 0.0 ELSE round((t.ms - s.ms) * 100.0::double / s.ms, 2) END AS delta_pct FROM
     (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0) * (user_id % 10) AS ms FROM events GROUP BY 1) s JOIN (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 1) * (user_id % 10) AS ms FROM events GROUP BY 1) t USING (user_id)""",
)
def perf(t: Tables):
    def side(bit):
        return t.events.groupBy("user_id").agg((F.count_if(F.col("event_id") % 2 == bit) * (F.col("user_id") % 10)).alias("ms"))

    return tm.perf_compare(side(0), side(1), "user_id", "ms")


@query("j21_tables_without_pk", "SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def without_pk(t: Tables):
    constraints = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return cmp.missing_rows(t.part.select("p_partkey", "p_name"), constraints, "p_partkey")


# ---- aggregates


@query("a20_job_success_rate", f"SELECT count(*) AS total_executions, count(*) FILTER (WHERE lifecycle = 'Succeeded') AS success_count, cast(cast(count(*) FILTER (WHERE lifecycle = 'Succeeded') * 100.0::double / count(*) AS decimal(5,2)) AS double) AS success_pct FROM {JOB_EXECUTIONS}")
def success(t: Tables):
    return jb.job_success_rate(job_executions(t))


@query("a21_job_retries", f"SELECT job_id, job_name, count(*) AS total_runs, count(*) FILTER (WHERE attempts > 1) AS retried_runs, max(attempts) AS max_attempts FROM {JOBS} JOIN {JOB_EXECUTIONS} USING (job_id) GROUP BY 1, 2")
def retries(t: Tables):
    return jb.job_retries(jobs(t), job_executions(t))


@query("a22_job_failure_trend", f"SELECT job_id, job_name, cast(cast(create_time AS date) AS varchar) AS failure_day, count(*) AS failures FROM {JOBS} JOIN {JOB_EXECUTIONS} USING (job_id) WHERE lifecycle IN ('Failed','TimedOut') GROUP BY 1, 2, 3")
def failures(t: Tables):
    return jb.job_failure_trend(jobs(t), job_executions(t))


@query(
    "a23_object_counts",
    f"SELECT schema_name, count(*) AS columns, count(DISTINCT table_name) AS tables, count(*) FILTER (WHERE data_type LIKE 'NUMBER%') AS number_columns, count(*) FILTER (WHERE table_name LIKE 'AUDIT%') AS audit_columns FROM {CATALOG} GROUP BY 1",
)
def objects(t: Tables):
    per = t.part.selectExpr(*CATALOG_EXPR).groupBy("schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("data_type").like("NUMBER%")).alias("n"), F.count_if(F.col("table_name").like("AUDIT%")).alias("a")
    )
    return per.groupBy("schema_name").agg(
        F.sum("c").alias("columns"), F.count(F.lit(1)).alias("tables"), F.sum("n").alias("number_columns"), F.sum("a").alias("audit_columns")
    )


@query("a24_session_mix", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS active_queries, count(*) FILTER (WHERE event_type = 'view') AS idle_sessions, count(*) AS total_sessions, max(value) AS max_query_time FROM events GROUP BY 1")
def mix(t: Tables):
    return tm.session_mix(t.events, ["user_id"], F.col("event_type") == "click", F.col("event_type") == "view", "value")


@query("a25_wait_profile", f"SELECT wait_type, count(*) AS session_count FROM {WAITS} WHERE wait_type NOT IN ('SLEEP_TASK','XE_TIMER_EVENT') GROUP BY 1")
def wait_profile(t: Tables):
    return tm.counts_by(tm.exclude_benign(waits(t), "wait_type"), ["wait_type"], "session_count")


@query("a27_size_by", "SELECT source, count(*) AS objects, round(sum(n_chars) / 1048576.0::double, 2) AS total_mb FROM documents GROUP BY 1")
def sizes(t: Tables):
    return tm.size_by(t.documents, "source", "n_chars")


@query("a28_volume_by_hour", f"SELECT date_trunc('hour', ts)::timestamp AS hour, count(*) AS n, cast(sum({V}) AS double) AS volume FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def hourly(t: Tables):
    return tm.volume_by_hour(t.events, "ts", F.expr(V), 7)


@query("a29_hit_ratio", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS hits, count(*) FILTER (WHERE l_returnflag <> 'A') AS reads, cast(count(*) FILTER (WHERE l_returnflag = 'A') AS double) * 1.0::double / count(*) AS hit_ratio FROM lineitem GROUP BY 1")
def hits(t: Tables):
    return tm.hit_ratio(t.lineitem, F.when(F.col("l_returnflag") == "A", 1).otherwise(0), F.when(F.col("l_returnflag") != "A", 1).otherwise(0), ["l_suppkey"])


@query("a30_status_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1")
def pivot(t: Tables):
    return tm.status_pivot(t.events, ["user_id"], "event_type", F.lit(1), ["click", "view", "error"])


@query("a31_ash", "SELECT date_trunc('minute', ts)::timestamp AS sample_minute, event_type, count(*) AS samples FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3000 MINUTE GROUP BY 1, 2")
def samples(t: Tables):
    return tm.ash(t.events, "ts", ["event_type"], 3000, newest(t.events, "ts"))


@query("a32_last_by", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_value FROM orders GROUP BY 1")
def last_value(t: Tables):
    return tm.last_by(t.orders, ["o_custkey"], "o_totalprice", "o_orderdate")


@query("a33_switch_statistics", "SELECT user_id, count(*) AS switches, min(ts) AS first_switch, max(ts) AS last_switch FROM events GROUP BY 1")
def switches(t: Tables):
    return tm.switch_statistics(t.events, "user_id", "ts")


@query(
    "a34_cardinality",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count, round(count(DISTINCT {c}) * 100.0::double / count(*), 4) AS cardinality_pct, round(count(DISTINCT {c}) * 100.0::double / count(*), 4) < 5 AS low_cardinality FROM lineitem"
        for c in ("l_partkey", "l_returnflag", "l_orderkey")
    ),
)
def cardinalities(t: Tables):
    a, b, c = (tm.cardinality(t.lineitem, x) for x in ("l_partkey", "l_returnflag", "l_orderkey"))
    return a.unionByName(b).unionByName(c)


@query(
    "a37_slow_log_rollup",
    f"SELECT event_type, count(*) AS statements, cast(sum({V}) AS double) AS total_time, cast(count(*) AS double) * 1.0::double / (SELECT count(*) FROM events WHERE value > 5) AS share FROM events WHERE value > 5 GROUP BY 1",
)
def slow_log(t: Tables):
    return tm.slow_log_rollup(t.events.where("value > 5"), "event_type", F.expr(V))


@query("a37_partition_counts", "SELECT user_id, count(*) AS items FROM events GROUP BY 1")
def partition_counts(t: Tables):
    return tm.counts_by(t.events, ["user_id"], "items")


# ---- top lists and detectors


@query(
    "t01_top_k",
    """SELECT l_partkey, calls, total, total / calls AS avg_per_call FROM (SELECT l_partkey, count(*) calls, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) total FROM lineitem GROUP BY 1) ORDER BY total DESC, l_partkey LIMIT 25""",
)
def top_sql(t: Tables):
    per = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return tm.per_call(tm.top_k(per, "total", 25, ["l_partkey"]), "total", "calls", "avg_per_call")


@query("t03_null_ordering", "SELECT user_id, coalesce(m, -1) AS m FROM (SELECT user_id, max(value) FILTER (WHERE value < 1 AND event_type = 'error') AS m FROM events GROUP BY 1) ORDER BY m IS NULL, m DESC, user_id LIMIT 140")
def nulls_last(t: Tables):
    per = t.events.groupBy("user_id").agg(F.max(F.when((F.col("value") < 1) & (F.col("event_type") == "error"), F.col("value"))).alias("m"))
    return tm.top_k(per, "m", 140, ["user_id"]).select("user_id", F.coalesce("m", F.lit(-1.0)).alias("m"))


@query(
    "u01_health_findings",
    """SELECT * FROM (SELECT 'BLOCKED_SESSIONS' AS issue, count(*) AS observed, 0.0::double AS threshold FROM events WHERE event_type = 'error'
     UNION ALL SELECT 'LONG_REQUESTS', count(*), 0.0 FROM events WHERE value > 100000
     UNION ALL SELECT 'AAS_CPU_PRESSURE', count(*), 100.0 FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
     UNION ALL SELECT 'NO_INDEX_STATEMENTS', count(*), 0.0 FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 40)) WHERE observed > threshold""",
)
def findings(t: Tables):
    from evenkeel.operators.marts import with_as_of

    one = t.events.agg(F.count_if(F.col("event_type") == "error").alias("blocked"), F.count_if(F.col("value") > 100000).alias("long"))
    aas = with_as_of(t.events, newest(t.events, "ts")).where("ts >= as_of - INTERVAL 1 DAY").agg(F.count(F.lit(1)).alias("aas"))
    no_index = t.lineitem.groupBy("l_partkey").count().where("count > 40").agg(F.count(F.lit(1)).alias("n"))
    return tm.health_findings([("BLOCKED_SESSIONS", one, "blocked", 0.0), ("LONG_REQUESTS", one, "long", 0.0), ("AAS_CPU_PRESSURE", aas, "aas", 100.0), ("NO_INDEX_STATEMENTS", no_index, "n", 0.0)])


BLOCKER = """CASE event_id % 4 WHEN 0 THEN 'idle_transaction' WHEN 1 THEN 'slow_query' WHEN 2 THEN 'ddl' ELSE 'other' END"""


@query(
    "l09_blocker_action",
    f"""SELECT event_id, kind, s, CASE WHEN kind = 'idle_transaction' THEN 'KILL' WHEN kind = 'slow_query' THEN CASE WHEN s < 120 THEN 'WAIT_AND_RETRY' ELSE 'KILL_IF_NOT_CRITICAL' END
     WHEN kind = 'ddl' THEN CASE WHEN s < 300 THEN 'WAIT' ELSE 'EVALUATE_CANCEL' END ELSE 'INVESTIGATE' END AS decision FROM (SELECT event_id, {BLOCKER} AS kind, event_id % 601 AS s FROM events)""",
)
def decisions(t: Tables):
    return bl.blocker_action(t.events.selectExpr("event_id", f"{BLOCKER} AS kind", "event_id % 601 AS s"), "kind", "s")


@query("l09_blocked_scope", "SELECT hour, n, CASE WHEN n >= 10 THEN 'POOL_EXHAUSTION' WHEN n >= 1 THEN 'DATA_LOCK' ELSE 'CLEAR' END AS scope FROM (SELECT date_trunc('hour', ts)::timestamp AS hour, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)")
def scopes(t: Tables):
    per = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return bl.blocked_scope(per, "n")
