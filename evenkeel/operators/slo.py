"""Service levels, alerts, capacity and cost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenkeel.functions.segments import exact_quantiles
from evenkeel.operators.marts import newest, recent, with_as_of
from evenkeel.operators.ordered import sustained

# p95 limit in milliseconds and availability target per tier.
TIER_P95_MS = {0: 50.0, 1: 120.0, 2: 2000.0}
TIER_AVAILABILITY = {0: 99.99, 1: 99.95, 2: 99.9}

# Alert kind to severity.
ALERT_SEVERITY = {
    "latency": "Sev-1", "error": "Sev-1", "availability": "Sev-1", "saturation": "Sev-2", "backup": "Sev-3", "replication_lag": "Sev-3",
}

# Weight of each statement risk, and the level each weight means.
RISK_WEIGHTS = {"delete_without_where": 100, "update_without_where": 100, "truncate": 100, "correlated_subquery": 20, "missing_index": 10}
BLOCK_LEVELS = {"strict": ["CRITICAL", "HIGH"], "moderate": ["CRITICAL"], "permissive": []}
ALERT_LEVELS = {"strict": [], "moderate": ["HIGH"], "permissive": []}


@dataclass(frozen=True)
class AlertRule:
    """Threshold on a windowed metric that must hold for ``for_seconds``."""

    name: str
    metric: str
    above: bool
    threshold: float
    for_seconds: int
    severity: str = "Sev-1"


# The alert catalogue.
ALERT_RULES = [
    AlertRule("DatabaseLatencyBreach", "latency_p95_ms", True, 100, 120),
    AlertRule("DatabaseLatencyWarning", "latency_p95_ms", True, 75, 60, "Sev-2"),
    AlertRule("DatabaseThroughputDrop", "qps", False, 1000, 60),
    AlertRule("DatabaseThroughputSpike", "qps", True, 20000, 30, "Sev-2"),
    AlertRule("ErrorRateBreach", "error_ratio", True, 0.001, 120),
    AlertRule("ErrorRateWarning", "error_ratio", True, 0.0005, 60, "Sev-2"),
    AlertRule("DatabaseCPUSaturation", "cpu_pct", True, 85, 120, "Sev-2"),
    AlertRule("DatabaseConnectionExhaustion", "connection_share", True, 0.9, 60, "Sev-2"),
    AlertRule("DatabaseIOPSSaturation", "iops_share", True, 0.8, 120, "Sev-2"),
    AlertRule("ReplicationLagHigh", "replication_lag_s", True, 10, 120, "Sev-3"),
    AlertRule("ReplicationLagCritical", "replication_lag_s", True, 60, 30, "Sev-3"),
    AlertRule("LongBlockingChain", "blocked_sessions", True, 10, 60, "Sev-2"),
    AlertRule("DeadlockRateHigh", "deadlocks_5m", True, 1, 30, "Sev-2"),
    AlertRule("BackupMissing", "backup_age_s", True, 90000, 600, "Sev-3"),
    AlertRule("high_replication_lag", "replication_lag_s", True, 5, 0, "Sev-3"),
    AlertRule("high_connections", "connection_share", True, 0.9, 0, "Sev-2"),
    AlertRule("slow_queries", "query_time_s", True, 2, 0),
]


def lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def latency_slo(df: DataFrame, keys: Sequence[str], value: str, tier: str) -> DataFrame:
    """Exact p50/p95/p99 and whether p95 stays inside the tier's limit."""
    q = exact_quantiles(df, [*keys, tier], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    out = q.select(*keys, tier, "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])
    limit = F.try_element_at(lookup(TIER_P95_MS), F.col(tier))
    return out.withColumn("limit_ms", limit).withColumn("within_slo", F.col("p95") < F.col("limit_ms"))


def error_budget(df: DataFrame, keys: Sequence[str], good: Column, target_pct: float) -> DataFrame:
    """Availability and how fast the error budget burns."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good"))
    errors = (F.col("total") - F.col("good")).cast("double") / F.col("total")
    budget = (F.lit(100.0) - F.lit(float(target_pct))) / F.lit(100.0)
    return out.withColumn("availability_pct", F.round(F.col("good") * F.lit(100.0) / F.col("total"), 6)).withColumn("burn_rate", F.round(errors / budget, 4))


def alert_severity(df: DataFrame, kind: str) -> DataFrame:
    """Severity of an alert kind; operational kinds are Sev-3."""
    return df.withColumn("severity", F.coalesce(F.try_element_at(lookup(ALERT_SEVERITY), F.col(kind)), F.lit("Sev-3")))


def forecast(df: DataFrame, keys: Sequence[str], ts: str, value: Column, horizons: Sequence[int] = (30, 90, 180), z: float = 1.96) -> DataFrame:
    """Linear projection of a daily total with a residual band."""
    daily = df.groupBy(*keys, F.unix_date(F.to_date(ts)).alias("day")).agg(F.sum(value).cast("double").alias("y"))
    # one row per key and day, so a window over a key is short
    w = Window.partitionBy(*keys)
    based = daily.withColumn("d0", F.min("day").over(w)).withColumn("d1", F.max("day").over(w)).withColumn("x", (F.col("day") - F.col("d0")).cast("double"))
    fit = based.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.max(F.col("d1") - F.col("d0")).alias("last_x"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.sqrt(F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("sse_root"),
    )
    band = F.lit(z) * F.col("sse_root") / F.sqrt(F.col("days") - F.lit(2.0))
    points = fit.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    y = F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("horizon_days"))
    return points.select(
        *keys,
        "horizon_days",
        F.round("slope", 4).alias("slope"),
        F.round(y, 3).alias("projected"),
        F.round(y - band, 3).alias("low"),
        F.round(y + band, 3).alias("high"),
    )


def trigger_days(fit: DataFrame, limit: float) -> DataFrame:
    """Days after the last sample until the projection meets a limit; null when it never does."""
    h = F.col("horizon_days") + (F.lit(limit) - F.col("projected")) / F.col("slope")
    return fit.withColumn("days_to_limit", F.when(F.col("slope") > 0, F.ceil(h)))


def unit_cost(cost: DataFrame, usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spend per million queries, gigabyte and transaction."""
    j = cost.join(usage, list(keys))
    return j.select(
        *keys,
        F.try_divide(F.col("spend") * F.lit(1e6), F.col("queries")).alias("per_million_queries"),
        F.try_divide(F.col("spend"), F.col("gigabytes")).alias("per_gb"),
        F.try_divide(F.col("spend"), F.col("transactions")).alias("per_transaction"),
    )


def perf_gate(baseline: DataFrame, current: DataFrame, query: str, seconds: str, tol: str = "0.10") -> DataFrame:
    """FAIL when a query slowed down by more than the tolerance; decimal arithmetic, so 10 % is 10 %."""
    b = baseline.select(query, F.col(seconds).cast("decimal(18,6)").alias("base"))
    c = current.select(query, F.col(seconds).cast("decimal(18,6)").alias("cur"))
    slower = F.col("cur") - F.col("base") > F.col("base") * F.lit(tol).cast("decimal(6,4)")
    return b.join(c, query).select(
        query, F.col("base").cast("double").alias("baseline"), F.col("cur").cast("double").alias("current"), F.when(slower, "FAIL").otherwise("PASS").alias("status")
    )


def perf_envelope(compared: DataFrame, pct: float = 20.0, share: float = 90.0) -> DataFrame:
    """Share of queries within the envelope, and the gate on it."""
    inside = F.round(F.count_if(F.abs("delta_pct") <= pct) * F.lit(100.0) / F.count(F.lit(1)), 4)
    return compared.agg(F.count(F.lit(1)).alias("queries"), inside.alias("inside_pct")).withColumn("status", F.when(F.col("inside_pct") >= share, "PASS").otherwise("FAIL"))


def dr_attainment(drills: DataFrame, fleet: DataFrame, service: str) -> DataFrame:
    """Actual recovery time and point against plan per drill."""
    j = drills.join(fleet.select(service, "rto_minutes", "rpo_minutes"), service)
    return j.withColumn("rto_met", F.col("actual_rto") <= F.col("rto_minutes")).withColumn("rpo_met", F.col("actual_rpo") <= F.col("rpo_minutes"))


#: What hides words of a statement: texts, quoted names and comments, whichever begins first.
HIDDEN = r"(?s)'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$(\w*)\$.*?\$\1\$|--[^\n]*|/\*.*?\*/"


def scanned(sql: str | Column) -> Column:
    """The statement in small letters with a mark in place of texts, quoted names and comments.

    Alternatives are tried where they begin, from left to right, so a quote inside a
    comment, or a comment inside a text, opens nothing.
    """
    return F.trim(F.regexp_replace(F.lower(sql), HIDDEN, " ~ "))


def outer_level(text: Column) -> Column:
    """The text without what stands in brackets: the innermost are taken out, once for each that opens."""
    opened = F.length(F.regexp_replace(text, r"[^(]", ""))
    return F.when(opened == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), opened), text, lambda left, _: F.regexp_replace(left, r"\([^()]*\)", " ")))


def score_statements(log: DataFrame, sql: str, no_index: str, level: str = "moderate") -> DataFrame:
    """Risk score, level and action of each statement.

    A condition counts only if it is the statement's own: one in a text, a comment or a
    subquery protects nothing.
    """
    text = F.regexp_replace(scanned(sql), r"^[\s;]*(~\s+)*", "")
    has_where = outer_level(text).rlike(r"\bwhere\b")
    weights = {
        "delete_without_where": text.rlike(r"^delete\s+from\b") & ~has_where,
        "update_without_where": text.rlike(r"^update\s+\S+\s+set\b") & ~has_where,
        "truncate": text.rlike(r"^truncate\b"),
        "correlated_subquery": text.rlike(r"\(\s*select\b[^()]*\bwhere\b[^()]*\b\w+\.\w+\s*=\s*\w+\.\w+"),
        "missing_index": F.coalesce(F.col(no_index), F.lit(False)),
    }
    parts = [F.when(cond, RISK_WEIGHTS[name]).otherwise(0) for name, cond in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    worst = F.greatest(*parts)
    risk = F.when(worst >= 100, "CRITICAL").when(worst >= 20, "HIGH").when(worst >= 10, "MEDIUM").otherwise("LOW")
    rules = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in weights.items()])), ",")
    action = F.when(F.col("risk_level").isin(*BLOCK_LEVELS[level]), "BLOCK").when(F.col("risk_level").isin(*ALERT_LEVELS[level]), "ALERT").otherwise(
        F.when(F.col("risk_score") > 0, "LOG").otherwise("ALLOW")
    )
    return log.withColumn("risk_score", total).withColumn("risk_level", risk).withColumn("violations", rules).withColumn("action_taken", action)


def violations_by_user(scored: DataFrame, user: str, ts: str, days: int = 30) -> DataFrame:
    """Violations and average risk per user over the last ``days``."""
    bad = recent(scored, ts, f"{days} DAYS").where("risk_score > 0")
    return bad.groupBy(user).agg(F.count(F.lit(1)).alias("violation_count"), (F.sum("risk_score").cast("double") / F.count(F.lit(1))).alias("avg_risk"))


def recent_violations(scored: DataFrame, ts: str, tiebreak: str, n: int = 20) -> DataFrame:
    """The newest violations."""
    return scored.where("risk_score > 0").orderBy(F.desc(ts), F.desc(tiebreak)).limit(n)


def index_candidates(stats: DataFrame, runs: int = 100, ms: float = 100.0, rows: int = 1000000, selectivity_pct: float = 5.0) -> DataFrame:
    """Frequent, slow, selective queries on large tables."""
    return stats.where((F.col("runs_per_day") > runs) & (F.col("avg_ms") > ms) & (F.col("table_rows") > rows) & (F.col("selectivity_pct") < selectivity_pct))


def cluster_pressure(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tombstone, fragmentation, throttling and hot-partition ratios."""
    per = df.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("throttled").alias("throttled"), F.sum("tombstones").alias("tombstones"), F.sum("live").alias("live")
    )
    return per.withColumn("__all", per.agg(F.sum("requests")).scalar()).select(
        *keys,
        F.round(F.try_divide(F.col("tombstones") * F.lit(100.0), F.col("tombstones") + F.col("live")), 4).alias("tombstone_pct"),
        F.round(F.try_divide(F.col("throttled") * F.lit(100.0), F.col("requests")), 4).alias("throttled_pct"),
        F.round(F.try_divide(F.col("requests") * F.lit(100.0), F.col("__all")), 4).alias("partition_share_pct"),
    )


def pre_post(df: DataFrame, ts: str, change: Column, value: str, keys: Sequence[str]) -> DataFrame:
    """Averages and volume before and after a change."""
    v = F.col(value).cast("decimal(18,2)")
    before = F.col(ts) < change
    out = df.groupBy(*keys).agg(
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"), F.sum(F.when(before, v)).alias("s0"), F.sum(F.when(~before, v)).alias("s1")
    )
    a, b = F.try_divide(F.col("s0").cast("double"), F.col("n_before")), F.try_divide(F.col("s1").cast("double"), F.col("n_after"))
    return out.select(*keys, "n_before", "n_after", F.round(a, 6).alias("avg_before"), F.round(b, 6).alias("avg_after"), F.round(F.try_divide((b - a) * 100.0, a), 4).alias("change_pct"))


def alert_quality(alerts: DataFrame, ts: str, name: str) -> DataFrame:
    """Fired per week, false alarms, incidents and mean repair time against targets."""
    # per day first: a span in weeks, and all counts, then come from few rows
    out = alerts.groupBy(name).agg(
        F.count(F.lit(1)).alias("fired"),
        F.count_if("false_alarm").alias("false_alarms"),
        F.count_if("incident").alias("incidents"),
        F.sum("mttr_minutes").alias("mttr_sum"),
        F.min(F.to_date(ts)).alias("d0"),
        F.max(F.to_date(ts)).alias("d1"),
    )
    weeks = F.greatest(F.lit(1.0), F.ceil((F.date_diff("d1", "d0") + 1) / F.lit(7.0)).cast("double"))
    return out.select(
        name,
        "fired",
        F.round(F.col("fired") / weeks, 4).alias("per_week"),
        F.round(F.col("false_alarms") * F.lit(100.0) / F.col("fired"), 4).alias("false_pct"),
        F.round(F.col("incidents") * F.lit(100.0) / F.col("fired"), 4).alias("incident_pct"),
        F.round(F.col("mttr_sum").cast("double") / F.col("fired"), 4).alias("mttr_minutes"),
    ).withColumn("healthy", (F.col("per_week") < 10) & (F.col("false_pct") < 20) & (F.col("incident_pct") > 70) & (F.col("mttr_minutes") < 10))


def time_to_breach(df: DataFrame, keys: Sequence[str], ts: str, value: str, limit: float, window_minutes: int) -> DataFrame:
    """Minutes until the trailing trend crosses a limit; null when it does not rise."""
    base = with_as_of(df, newest(df, ts)).where(F.col(ts) >= F.col("as_of") - F.expr(f"INTERVAL {window_minutes} MINUTES"))
    x = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / F.lit(6e7)
    fit = base.select(*keys, x.alias("x"), F.col(value).cast("double").alias("y")).groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("now"))
    return fit.select(
        *keys,
        F.round("now", 3).alias("value_now"),
        F.when(F.col("slope") > 0, F.round((F.lit(limit) - F.col("now")) / F.col("slope"), 1)).alias("minutes_to_limit"),
    )


# ---- windowed alerts


def window_metrics(df: DataFrame, ts: str, keys: Sequence[str], window: str, slide: str, aggs: dict[str, Column]) -> DataFrame:
    """Sliding-window aggregates as long rows (C15). Works on batch and streaming frames."""
    w = F.window(F.col(ts).cast("timestamp"), window, slide)
    out = df.groupBy(w.alias("w"), *keys).agg(*[a.cast("double").alias(m) for m, a in aggs.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in aggs])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, F.explode(pairs).alias("p")).select("window_start", *keys, "p.*")


def pane_counts(df: DataFrame, ts: str, keys: Sequence[str], slide: str, value: str, bad: Column | None = None) -> DataFrame:
    """How often each value came in each pane of ``slide`` (C15). Batch or streaming.

    Counts of different batches add up, and those of a window's panes give its exact
    quantile; ``bad`` tells apart rows that count as errors.
    """
    w = F.window(F.col(ts).cast("timestamp"), slide)
    marked = df.withColumn("__bad", F.coalesce(bad if bad is not None else F.lit(False), F.lit(False)))
    counted = marked.groupBy(w.alias("w"), *keys, value, "__bad").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("pane"), *keys, F.col(value).alias("value"), F.col("__bad").alias("bad"), "n")


def windows_of_panes(panes: DataFrame, window: str, slide: str) -> DataFrame:
    """Each pane's counts once for every sliding window that it is in; ``window`` must hold whole panes."""
    if pd.Timedelta(window) % pd.Timedelta(slide):
        raise ValueError(f"a window of {window} has no whole number of panes of {slide}")
    start = F.window(F.col("pane").cast("timestamp"), window, slide)["start"].cast("timestamp_ntz")
    return panes.select("*", start.alias("window_start")).drop("pane")


def metrics_of_panes(panes: DataFrame, keys: Sequence[str], window: str, slide: str, p: float = 0.95) -> DataFrame:
    """``latency_p95`` (or another percentile), ``error_ratio`` and ``events`` per sliding window, from pane counts."""
    w = windows_of_panes(panes, window, slide)
    q = exact_quantiles(w, ["window_start", *keys], "value", {"q": p}, "n")
    quantile = q.select("window_start", *keys, F.lit(f"latency_p{p * 100:g}").alias("metric"), F.round("q", 6).alias("value"))
    n, bad = F.sum("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))
    sums = w.groupBy("window_start", *keys).agg((bad.cast("double") / n).alias("error_ratio"), n.cast("double").alias("events"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("error_ratio", "events")])
    return quantile.unionByName(sums.select("window_start", *keys, F.explode(pairs).alias("p")).select("window_start", *keys, "p.*"))


def window_quantile(df: DataFrame, ts: str, keys: Sequence[str], window: str, slide: str, value: str, p: float, metric: str) -> DataFrame:
    """Exact quantile per sliding window (C15): values are counted per pane before panes are copied to their windows."""
    w = windows_of_panes(pane_counts(df, ts, keys, slide, value), window, slide)
    q = exact_quantiles(w, ["window_start", *keys], "value", {"q": p}, "n")
    return q.select("window_start", *keys, F.lit(metric).alias("metric"), F.round("q", 6).alias("value"))


def rule_rows(spark: SparkSession, rules: Sequence[AlertRule]) -> DataFrame:
    """The rules as rows: a fixed list, so it can be broadcast."""
    data = [(r.name, r.metric, r.above, float(r.threshold), r.for_seconds, r.severity) for r in rules]
    return spark.createDataFrame(data, "alert string, metric string, above boolean, threshold double, for_seconds long, severity string")


def evaluate_rules(metrics: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Each window metric against each of its rules (C15). Batch or streaming."""
    r = F.broadcast(rule_rows(metrics.sparkSession, rules))
    breach = F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return metrics.join(r, "metric").withColumn("breached", breach)


def fired_alerts(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alerts whose condition held for the rule's duration (C15); windows are the samples."""
    spans = sustained(evaluated, ["alert", "severity", "for_seconds", *keys], ["window_start"], F.col("breached"), 0)
    return spans.where(F.col("duration_s") >= F.col("for_seconds")).drop("for_seconds")


def composite_alert(metrics: DataFrame, keys: Sequence[str], conditions: dict[str, float], seconds: int) -> DataFrame:
    """All metrics above their limits in the same windows for a while."""
    names = list(conditions)
    wide = metrics.where(F.col("metric").isin(*names)).groupBy("window_start", *keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    cond = F.lit(True)
    for m, limit in conditions.items():
        cond = cond & (F.col(m) > limit)
    return sustained(wide, keys, ["window_start"], cond, seconds)


def interval_rollup(df: DataFrame, ts: str, keys: Sequence[str], value: str, every: str = "30 minutes") -> DataFrame:
    """Average, maximum and total per capture interval (C17). Batch or streaming."""
    v = F.col(value).cast("decimal(18,2)")
    out = df.groupBy(F.window(F.col(ts).cast("timestamp"), every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("total"), F.max(v).cast("double").alias("maximum"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("interval_start"), *keys, "n", (F.col("total") / F.col("n")).alias("average"), "maximum", "total")
