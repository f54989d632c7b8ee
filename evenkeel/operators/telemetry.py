"""Sessions, waits, caches, sizes and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.operators.marts import with_as_of

# Wait types that only mean "nothing to do".
BENIGN_WAITS = [
    "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "LAZYWRITER_SLEEP", "RESOURCE_QUEUE", "SLEEP_TASK", "SLEEP_SYSTEMTASK",
    "SQLTRACE_BUFFER_FLUSH", "WAITFOR", "LOGMGR_QUEUE", "CHECKPOINT_QUEUE", "REQUEST_FOR_DEADLOCK_SEARCH",
    "XE_TIMER_EVENT", "BROKER_TO_FLUSH", "BROKER_TASK_STOP", "CLR_SEMAPHORE", "DIRTY_PAGE_POLL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "ONDEMAND_TASK_QUEUE",
    "DISPATCHER_QUEUE_SEMAPHORE", "FT_IFTS_SCHEDULER_IDLE_WAIT", "XE_DISPATCHER_WAIT",
    "XE_DISPATCHER_JOIN", "BROKER_EVENTHANDLER", "TRACEWRITE", "SOS_WORK_DISPATCHER",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE", "SP_SERVER_DIAGNOSTICS_SLEEP",
]
# Schemas owned by the engine itself.
SYSTEM_SCHEMAS = ["mysql", "performance_schema", "information_schema", "sys"]

# Wait category and the patterns that lead to it, first match wins.
WAIT_CATEGORIES = [
    ("Lock", "^LCK_"),
    ("IO/Log", "^(PAGEIOLATCH_|IO_)|^(WRITELOG|LOGBUFFER)$"),
    ("Parallelism", "^CX"),
    ("Memory", "^(RESOURCE_SEMAPHORE|MEMORY_)"),
    ("CPU/Scheduler", "^(SOS_SCHEDULER_YIELD|THREADPOOL)$"),
    ("HADR", "^HADR_"),
    ("Latch", "^PAGELATCH_"),
]


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def exclude_benign(df: DataFrame, col: str, names: Sequence[str] = BENIGN_WAITS, like: Sequence[str] = ()) -> DataFrame:
    """Drop listed names and patterns."""
    out = df.where(~F.col(col).isin(*names))
    for pattern in like:
        out = out.where(~F.col(col).like(pattern))
    return out


def wait_category(col: str) -> Column:
    """Category of a wait type."""
    out = None
    for name, pattern in WAIT_CATEGORIES:
        hit = F.col(col).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def precheck(df: DataFrame, keys: Sequence[str], threshold: int = 100) -> DataFrame:
    """reject above the session limit, approve at or below it (P10)."""
    per = df.groupBy(*keys).agg(_n("sessions"))
    return per.withColumn("decision", F.when(F.col("sessions") > threshold, "reject").otherwise("approve"))


def route(df: DataFrame, kind: str) -> DataFrame:
    """Event type to action to execution result."""
    action = F.when(F.col(kind) == "health_threshold_reached", "prepare_action").otherwise("no_action")
    return df.withColumn("action", action).withColumn(
        "execution", F.when(F.col("action") == "prepare_action", "execution_triggered").otherwise("no_execution")
    )


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    return F.try_divide(num.cast("double") * F.lit(scale), den.cast("double"))


def hot_files(df: DataFrame, limit_ms: float = 20.0) -> DataFrame:
    """Files whose average read or write stall exceeds the limit."""
    r = F.coalesce(ratio(F.col("stall_read_ms"), F.col("reads")), F.lit(0.0))
    w = F.coalesce(ratio(F.col("stall_write_ms"), F.col("writes")), F.lit(0.0))
    return df.withColumn("avg_read_stall_ms", r).withColumn("avg_write_stall_ms", w).where(
        (F.col("avg_read_stall_ms") > limit_ms) | (F.col("avg_write_stall_ms") > limit_ms)
    )


def bloat_risk(df: DataFrame, dead_rows: int = 10000, dead_pct: float = 10.0) -> DataFrame:
    """Tables with many or a large share of dead rows."""
    pct = ratio(F.col("dead"), F.col("live") + F.col("dead"), 100.0)
    return df.withColumn("dead_pct", pct).where((F.col("dead") > dead_rows) | (F.col("dead_pct") > dead_pct))


def low_hit(df: DataFrame, min_reads: int = 10000, hit_pct: float = 95.0) -> DataFrame:
    """Heavily read tables with a poor cache hit share."""
    pct = ratio(F.col("hits"), F.col("hits") + F.col("reads"), 100.0)
    return df.withColumn("hit_pct", pct).where((F.col("reads") > min_reads) & (F.col("hit_pct") < hit_pct))


def read_heavy(df: DataFrame, times: int = 10) -> DataFrame:
    """Read far more than written."""
    return df.where(F.col("reads") > F.col("writes") * times)


def improvement_measure(df: DataFrame) -> DataFrame:
    """cost x impact/100 x (seeks + scans) of a missing index."""
    m = F.col("avg_total_user_cost") * (F.col("avg_user_impact") / F.lit(100.0)) * (F.col("user_seeks") + F.col("user_scans"))
    return df.withColumn("improvement_measure", m)


def replica_lag(df: DataFrame, limit: float) -> DataFrame:
    """Distance of a replica behind its log and its state."""
    lag = F.col("log_max_index") - F.col("log_pointer")
    return df.withColumn("replication_lag", lag).withColumn("lag_state", F.when(F.col("replication_lag") > limit, "LAGGING").otherwise("OK"))


def long_running(df: DataFrame, start: str, seconds: int, as_of: DataFrame, idle: Column | None = None) -> DataFrame:
    """Work in progress for longer than the limit (P20); sort oldest first at the sink."""
    age = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1e6)
    out = with_as_of(df, as_of).withColumn("age_seconds", age).drop("as_of").where(F.col("age_seconds") > seconds)
    return out if idle is None else out.where(~idle)


def deadlock_events(df: DataFrame, xml: str, n: int | None = 10) -> DataFrame:
    """Time, victim and sizes of each deadlock report, newest first."""
    base = "event/data/value/deadlock"
    parts = ["event/@timestamp", f"{base}/process-list/process[1]/@spid", f"count({base}/process-list/process)", f"count({base}/resource-list/*)"]
    # one expression, so each document is parsed once
    found = F.split(F.xpath_string(F.col(xml), F.lit("concat(" + ", '|', ".join(parts) + ")")), r"\|")
    out = df.select(found.alias("f")).select(
        F.col("f")[0].alias("event_time_utc"),
        F.col("f")[1].try_cast("int").alias("victim_spid"),
        F.col("f")[2].try_cast("int").alias("process_count"),
        F.col("f")[3].try_cast("int").alias("resource_count"),
    )
    return out if n is None else out.orderBy(F.desc("event_time_utc"), "victim_spid", "process_count", "resource_count").limit(n)


def utilisation(df: DataFrame, used: str, limit: str, warn: float, alert: float) -> DataFrame:
    """Used share of a limit and its state."""
    out = df.withColumn("used_pct", F.round(ratio(F.col(used), F.col(limit), 100.0), 2))
    return out.withColumn("state", F.when(F.col("used_pct") >= alert, "ALERT").when(F.col("used_pct") >= warn, "WARN").otherwise("OK"))


def session_mix(df: DataFrame, keys: Sequence[str], active: Column, idle: Column, duration: str) -> DataFrame:
    """Sessions per group, active and idle counts, longest time."""
    return df.groupBy(*keys).agg(
        F.count_if(active).alias("active_queries"), F.count_if(idle).alias("idle_sessions"), _n("total_sessions"), F.max(duration).alias("max_query_time")
    )


def counts_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group: wait profile, lock inventory, plan cache, partitions."""
    return df.groupBy(*keys).agg(_n(name))


def size_by(df: DataFrame, key: str, size: str, divisor: float = 1048576.0) -> DataFrame:
    """Objects and megabytes per schema or owner."""
    return df.groupBy(key).agg(_n("objects"), F.round(F.sum(size) / F.lit(divisor), 2).alias("total_mb"))


def volume_by_hour(df: DataFrame, ts: str, amount: Column, days: int | None = None) -> DataFrame:
    """Volume per hour of the last ``days``."""
    from evenkeel.operators.marts import recent

    base = df if days is None else recent(df, ts, f"{days} DAYS")
    return base.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(_n("n"), F.sum(amount).cast("double").alias("volume"))


def hit_ratio(df: DataFrame, hit: Column, read: Column, keys: Sequence[str] = ()) -> DataFrame:
    """hits / (hits + reads), null when there were none."""
    return df.groupBy(*keys).agg(F.sum(hit).alias("hits"), F.sum(read).alias("reads")).withColumn("hit_ratio", ratio(F.col("hits"), F.col("hits") + F.col("reads")))


def status_pivot(df: DataFrame, keys: Sequence[str], name: str, value: Column, names: Sequence[str]) -> DataFrame:
    """Named counters as columns (A30); names are given, so no extra scan finds them."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(name) == n, value)), F.lit(0)).alias(n) for n in names])


def ash(df: DataFrame, ts: str, keys: Sequence[str], minutes: int, as_of: DataFrame) -> DataFrame:
    """Active samples per minute and state over the trailing minutes."""
    base = with_as_of(df, as_of).where(F.col(ts) >= F.col("as_of") - F.expr(f"INTERVAL {minutes} MINUTES")).drop("as_of")
    return base.groupBy(F.date_trunc("minute", ts).cast("timestamp_ntz").alias("sample_minute"), *keys).agg(_n("samples"))


def last_by(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """Value at the highest position; ties give the largest value."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(seq, value)).alias("last_value"))


def switch_statistics(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Log switches per thread with first and last time."""
    return df.groupBy(key).agg(_n("switches"), F.min(ts).alias("first_switch"), F.max(ts).alias("last_switch"))


def cardinality(df: DataFrame, col: str, flag_pct: float = 5.0) -> DataFrame:
    """Distinct values as percent of rows (A34), counted per value first."""
    per = df.groupBy(col).agg(_n("n"))
    out = per.agg(F.count(col).alias("distinct_values"), F.sum("n").alias("row_count"))
    out = out.withColumn("cardinality_pct", F.round(ratio(F.col("distinct_values"), F.col("row_count"), 100.0), 4))
    return out.select(F.lit(col).alias("column_name"), "*", (F.col("cardinality_pct") < flag_pct).alias("low_cardinality"))


def slow_log_rollup(df: DataFrame, key: str, seconds: Column) -> DataFrame:
    """Slow statements and total time per database, with share of all."""
    per = df.groupBy(key).agg(_n("statements"), F.sum(seconds).cast("double").alias("total_time"))
    return per.withColumn("share", ratio(F.col("statements"), per.agg(F.sum("statements")).scalar()))


def top_k(df: DataFrame, metric: str, k: int, tiebreak: Sequence[str], nulls_last: bool = True) -> DataFrame:
    """k highest rows, nulls last, explicit tie break."""
    first = F.desc_nulls_last(metric) if nulls_last else F.desc(metric)
    return df.orderBy(first, *tiebreak).limit(k)


def per_call(df: DataFrame, total: str, calls: str, out: str) -> DataFrame:
    """Derived average of a cumulative counter."""
    return df.withColumn(out, ratio(F.col(total), F.col(calls)))


def health_findings(checks: Sequence[tuple[str, DataFrame, str, float]]) -> DataFrame:
    """One row per active issue: observed value above its threshold.

    Each check is (issue, one-row frame, column, threshold).
    """
    out = None
    for issue, frame, col, threshold in checks:
        row = frame.select(F.lit(issue).alias("issue"), F.col(col).cast("long").alias("observed"), F.lit(threshold).cast("double").alias("threshold"))
        row = row.where(F.col("observed") > F.col("threshold"))
        out = row if out is None else out.unionByName(row)
    return out


def with_statement_text(stats: DataFrame, texts: DataFrame, handle: str, keep_unmatched: bool = True) -> DataFrame:
    """Statement text per row: CROSS APPLY is an inner join on the handle, OUTER APPLY a left one."""
    return stats.join(texts, handle, "left" if keep_unmatched else "inner")


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row aggregates side by side (J17, J18); the others have one column each."""
    return first.withColumns({f.columns[0]: f.scalar() for f in others})


def perf_compare(src: DataFrame, tgt: DataFrame, query: str, ms: str) -> DataFrame:
    """Percent change of each query's time, 0 when the source took none."""
    s, g = src.select(query, F.col(ms).alias("source_ms")), tgt.select(query, F.col(ms).alias("target_ms"))
    delta = F.round((F.col("target_ms") - F.col("source_ms")) * F.lit(100.0) / F.col("source_ms"), 2)
    return s.join(g, query).withColumn("delta_pct", F.when(F.col("source_ms") == 0, F.lit(0.0)).otherwise(delta))
