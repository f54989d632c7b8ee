"""Service levels, alerts, forecasts and statement risk over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import slo, telemetry as tm
from evenkeel.plans.registry import Tables, query
from evenkeel.session import cut_lineage

TIER = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END"


@query(
    "l01_latency_slo",
    f"""SELECT event_type, tier, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, l AS limit_ms, round(p95, 6) < l AS within_slo FROM (
      SELECT event_type, {TIER} AS tier, count(*) AS n, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95, quantile_cont(value, 0.99) p99, CASE {TIER} WHEN 0 THEN 50.0 WHEN 1 THEN 120.0 ELSE 2000.0 END::double AS l FROM events GROUP BY event_type, 2, 7)""",
)
def latency(t: Tables):
    return slo.latency_slo(t.events.withColumn("tier", F.expr(TIER)), ["event_type"], "value", "tier")


@query(
    "l02_error_budget",
    """SELECT day, total, good, round(good * 100.0::double / total, 6) AS availability_pct, round(cast(total - good AS double) / total / ((100.0::double - 99.9::double) / 100.0::double), 4) AS burn_rate
     FROM (SELECT cast(cast(ts AS date) AS varchar) AS day, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY 1)""",
)
def budget(t: Tables):
    return slo.error_budget(t.events.select(F.to_date("ts").cast("string").alias("day"), "event_type"), ["day"], F.col("event_type") != "error", 99.9)


KIND = "CASE event_type WHEN 'click' THEN 'latency' WHEN 'error' THEN 'error' WHEN 'view' THEN 'saturation' WHEN 'signup' THEN 'availability' ELSE 'backup' END"


@query("l03_alert_severity", f"SELECT event_id, kind, CASE kind WHEN 'saturation' THEN 'Sev-2' WHEN 'backup' THEN 'Sev-3' ELSE 'Sev-1' END AS severity FROM (SELECT event_id, {KIND} AS kind FROM events)")
def severities(t: Tables):
    return slo.alert_severity(t.events.selectExpr("event_id", f"{KIND} AS kind"), "kind")


@query(
    "l04_forecast",
    """WITH d AS (SELECT event_type, cast(ts AS date) - DATE '1970-01-01' AS day, cast(sum(cast(value AS decimal(18,2))) AS double) AS y FROM events GROUP BY 1, 2),
      x AS (SELECT *, cast(day - min(day) OVER (PARTITION BY event_type) AS double) AS x FROM d),
      f AS (SELECT event_type, count(*) n, max(x) lx, regr_slope(y, x) b, regr_intercept(y, x) a, sqrt(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) s FROM x GROUP BY 1),
      h AS (SELECT *, unnest([30, 90, 180]) AS h FROM f)
     SELECT event_type, h AS horizon_days, round(b, 4) AS slope, round(a + b * (lx + h), 3) AS projected, round(a + b * (lx + h) - 1.96 * s / sqrt(n - 2.0), 3) AS low, round(a + b * (lx + h) + 1.96 * s / sqrt(n - 2.0), 3) AS high FROM h""",
)
def forecasts(t: Tables):
    return slo.forecast(t.events, ["event_type"], "ts", F.col("value").cast("decimal(18,2)"))


@query(
    "l05_unit_cost",
    """SELECT o_custkey, s * 1e6 / q AS per_million_queries, s / g AS per_gb, s / x AS per_transaction FROM (SELECT o_custkey, cast(sum(cast(o_totalprice AS decimal(15,2))) AS double) AS s FROM orders GROUP BY 1)
     JOIN (SELECT o_custkey, count(*) * 1000 AS q, count(DISTINCT o_orderkey) AS x, 1 + o_custkey % 50 AS g FROM orders GROUP BY o_custkey) USING (o_custkey)""",
)
def costs(t: Tables):
    cost = t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("spend"))
    usage = t.orders.groupBy("o_custkey").agg((F.count(F.lit(1)) * 1000).alias("queries"), F.count(F.lit(1)).alias("transactions")).withColumn("gigabytes", 1 + F.col("o_custkey") % 50)
    return slo.unit_cost(cost, usage, ["o_custkey"])


def timing(t: Tables, bit: int):
    return t.events.where(F.col("event_id") % 2 == bit).groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("seconds"))


@query(
    "l06_perf_gate",
    """SELECT user_id, cast(b AS double) AS baseline, cast(c AS double) AS current, CASE WHEN c - b > b * 0.10 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT user_id, sum(cast(value AS decimal(18,2))) FILTER (WHERE event_id % 2 = 0) b, sum(cast(value AS decimal(18,2))) FILTER (WHERE event_id % 2 = 1) c FROM events GROUP BY 1)
     WHERE b IS NOT NULL AND c IS NOT NULL""",
)
def gate(t: Tables):
    return slo.perf_gate(timing(t, 0), timing(t, 1), "user_id", "seconds")


@query(
    "l07_perf_envelope",
    """SELECT count(*) AS queries, round(count(*) FILTER (WHERE abs(d) <= 20) * 100.0::double / count(*), 4) AS inside_pct, CASE WHEN count(*) FILTER (WHERE abs(d) <= 20) * 100.0::double / count(*) >= 90 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
       SELECT CASE WHEN s = 0 THEN 0.0 ELSE round((g - s) * 100.0::double / s, 2) END AS d FROM (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0) s, count(*) FILTER (WHERE event_id % 2 = 1) g FROM events GROUP BY 1))""",
)
def envelope(t: Tables):
    def side(bit):
        return t.events.groupBy("user_id").agg(F.count_if(F.col("event_id") % 2 == bit).alias("ms"))

    return slo.perf_envelope(tm.perf_compare(side(0), side(1), "user_id", "ms"))


@query(
    "l08_dr_attainment",
    """SELECT o_orderkey, o_orderkey % 90 <= 10 + c_nationkey * 3 AS rto_met, o_orderkey % 31 <= 5 + c_nationkey AS rpo_met FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def drills(t: Tables):
    d = t.orders.selectExpr("o_orderkey", "o_custkey AS service", "o_orderkey % 90 AS actual_rto", "o_orderkey % 31 AS actual_rpo")
    fleet = t.customer.selectExpr("c_custkey AS service", "10 + c_nationkey * 3 AS rto_minutes", "5 + c_nationkey AS rpo_minutes")
    return slo.dr_attainment(d, fleet, "service").select("o_orderkey", "rto_met", "rpo_met")


STATEMENT = """CASE event_id % 12 WHEN 0 THEN 'DELETE FROM t' || user_id WHEN 1 THEN 'delete from t' || user_id || ' where id = 1' WHEN 2 THEN 'UPDATE t' || user_id || ' SET a = 1'
  WHEN 3 THEN 'UPDATE t' || user_id || ' SET a = 1 WHERE b = 2' WHEN 4 THEN 'TRUNCATE TABLE t' || user_id WHEN 5 THEN 'SELECT * FROM a WHERE x IN (SELECT y FROM b WHERE b.id = a.id)'
  WHEN 6 THEN 'SELECT * FROM a WHERE x IN (SELECT y FROM b WHERE z = 1)' WHEN 7 THEN 'INSERT INTO t VALUES (1)' WHEN 8 THEN '  delete  from t' || user_id WHEN 9 THEN 'SELECT truncate(1.5)'
  WHEN 10 THEN 'DELETE FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k)' ELSE 'SELECT 1' END"""
SCORED = f"""(WITH s AS (SELECT event_id, user_id, ts, lower(trim({STATEMENT})) AS q, event_id % 5 = 0 AS ni FROM events),
  f AS (SELECT *, regexp_matches(q, '^delete\\s+from\\b') AND NOT regexp_matches(q, '\\bwhere\\b') AS d, regexp_matches(q, '^update\\s+\\S+\\s+set\\b') AND NOT regexp_matches(q, '\\bwhere\\b') AS u, starts_with(q, 'truncate ') AS tr,
    regexp_matches(q, '\\(\\s*select\\b[^()]*\\bwhere\\b[^()]*\\b\\w+\\.\\w+\\s*=\\s*\\w+\\.\\w+') AS c FROM s)
  SELECT event_id, user_id, ts, (CASE WHEN d THEN 100 ELSE 0 END) + (CASE WHEN u THEN 100 ELSE 0 END) + (CASE WHEN tr THEN 100 ELSE 0 END) + (CASE WHEN c THEN 20 ELSE 0 END) + (CASE WHEN ni THEN 10 ELSE 0 END) AS risk_score,
    CASE WHEN d OR u OR tr THEN 'CRITICAL' WHEN c THEN 'HIGH' WHEN ni THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN d OR u OR tr THEN 'BLOCK' WHEN c THEN 'ALERT' WHEN ni THEN 'LOG' ELSE 'ALLOW' END AS action_taken FROM f)"""


def scored(t: Tables):
    return slo.score_statements(t.events.selectExpr("event_id", "user_id", "ts", f"{STATEMENT} AS q", "event_id % 5 = 0 AS ni"), "q", "ni")


@query("l10_score_statements", f"SELECT event_id, risk_score, risk_level, action_taken FROM {SCORED}")
def statements(t: Tables):
    return scored(t).select("event_id", "risk_score", "risk_level", "action_taken")


# statements of orders, each with words that must not count; the twin knows which kind is which
TRAPS = [
    ("DELETE FROM orders -- where o_orderkey = #", "delete_without_where"),
    ("DELETE FROM orders WHERE note = 'it''s -- gone' AND o_orderkey = #", ""),
    ("UPDATE orders SET note = 'where #'", "update_without_where"),
    ("DELETE FROM orders USING (SELECT k FROM t WHERE k IN (1, (2))) AS s /* where # */", "delete_without_where"),
    ("/* first */ UPDATE orders SET a = (SELECT max(b) FROM t WHERE c = 1) WHERE o_orderkey = #", ""),
    ("-- truncate\nSELECT \"delete from\" FROM t WHERE k = '(' AND n = #", ""),
    ("TRUNCATE TABLE t#", "truncate"),
    ("DELETE FROM \"where\" /* it's # */", "delete_without_where"),
]


@query(
    "l10_scanned_statements",
    "SELECT o_orderkey, v AS violations, CASE WHEN v = '' THEN 0 ELSE 100 END AS risk_score, CASE WHEN v = '' THEN 'LOW' ELSE 'CRITICAL' END AS risk_level FROM (SELECT o_orderkey, CASE o_orderkey % 8 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(TRAPS))
    + " END AS v FROM orders)",
)
def scanned_statements(t: Tables):
    text = F.element_at(F.array(*[F.lit(x) for x, _ in TRAPS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    log = t.orders.select("o_orderkey", F.replace(text, F.lit("#"), F.col("o_orderkey").cast("string")).alias("sql_text"), F.lit(False).alias("no_index"))
    return slo.score_statements(log, "sql_text", "no_index").select("o_orderkey", "violations", "risk_score", "risk_level")


@query("a35_violations_by_user", f"SELECT user_id, count(*) AS violation_count, cast(sum(risk_score) AS double) / count(*) AS avg_risk FROM {SCORED} WHERE risk_score > 0 AND ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def violators(t: Tables):
    return slo.violations_by_user(scored(t), "user_id", "ts")


@query("a35_recent_violations", f"SELECT event_id, user_id, risk_score, action_taken FROM {SCORED} WHERE risk_score > 0 ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_violations(t: Tables):
    return slo.recent_violations(scored(t), "ts", "event_id").select("event_id", "user_id", "risk_score", "action_taken")


@query(
    "l12_index_candidates",
    """SELECT l_partkey FROM (SELECT l_partkey, count(*) AS r, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) / count(*) AS a, max(l_extendedprice) AS x, count(*) FILTER (WHERE l_returnflag = 'A') * 100.0::double / count(*) AS s FROM lineitem GROUP BY 1) WHERE r > 25 AND a > 25 AND x > 90000 AND s < 40""",
)
def candidates(t: Tables):
    per = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("runs_per_day"),
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("avg_ms"),
        F.max("l_extendedprice").alias("table_rows"),
        (F.count_if(F.col("l_returnflag") == "A") * F.lit(100.0) / F.count(F.lit(1))).alias("selectivity_pct"),
    )
    return slo.index_candidates(per, 25, 25.0, 90000, 40.0).select("l_partkey")


@query(
    "l13_cluster_pressure",
    """SELECT user_id, round(x * 100.0::double / (x + l), 4) AS tombstone_pct, round(e * 100.0::double / n, 4) AS throttled_pct, round(n * 100.0::double / (SELECT count(*) FROM events), 4) AS partition_share_pct
     FROM (SELECT user_id, count(*) n, count(*) FILTER (WHERE event_type = 'error') e, count(*) FILTER (WHERE event_type = 'view') x, count(*) FILTER (WHERE event_type <> 'view') l FROM events GROUP BY 1)""",
)
def pressure(t: Tables):
    one = t.events.select(
        "user_id",
        F.lit(1).alias("requests"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("throttled"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("tombstones"),
        F.when(F.col("event_type") != "view", 1).otherwise(0).alias("live"),
    )
    return slo.cluster_pressure(one, ["user_id"])


@query(
    "l14_pre_post",
    """SELECT event_type, n0 AS n_before, n1 AS n_after, round(a, 6) AS avg_before, round(b, 6) AS avg_after, round((b - a) * 100.0::double / a, 4) AS change_pct FROM (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') n0, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') n1,
       cast(sum(cast(value AS decimal(18,2))) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS double) / count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') a, cast(sum(cast(value AS decimal(18,2))) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS double) / count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') b FROM events GROUP BY 1)""",
)
def before_after(t: Tables):
    return slo.pre_post(t.events, "ts", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "value", ["event_type"])


@query(
    "l15_alert_quality",
    """SELECT *, per_week < 10 AND false_pct < 20 AND incident_pct > 70 AND mttr_minutes < 10 AS healthy FROM (SELECT user_id, fired, round(fired / greatest(1.0::double, ceil((d1 - d0 + 1) / 7.0::double)), 4) AS per_week, round(fa * 100.0::double / fired, 4) AS false_pct, round(inc * 100.0::double / fired, 4) AS incident_pct, round(cast(m AS double) / fired, 4) AS mttr_minutes FROM (
      SELECT user_id, count(*) AS fired, count(*) FILTER (WHERE event_id % 7 = 0) fa, count(*) FILTER (WHERE event_id % 4 <> 0) inc, sum(event_id % 19) m, min(cast(ts AS date)) d0, max(cast(ts AS date)) d1 FROM events WHERE event_type = 'error' GROUP BY 1))""",
)
def quality(t: Tables):
    a = t.events.where("event_type = 'error'").selectExpr("user_id", "ts", "event_id % 7 = 0 AS false_alarm", "event_id % 4 <> 0 AS incident", "event_id % 19 AS mttr_minutes")
    return slo.alert_quality(a, "ts", "user_id")


@query(
    "l16_time_to_breach",
    """WITH m AS (SELECT max(ts) m FROM events), f AS (SELECT event_type, regr_slope(value, (epoch_us(ts) - epoch_us(m)) / 6e7) b, regr_intercept(value, (epoch_us(ts) - epoch_us(m)) / 6e7) a FROM events, m WHERE ts >= m - INTERVAL 20000 MINUTE GROUP BY 1)
     SELECT event_type, round(a, 3) AS value_now, coalesce(CASE WHEN b > 0 THEN round((1000.0::double - a) / b, 1) END, -1) AS minutes_to_limit FROM f""",
)
def breach(t: Tables):
    out = slo.time_to_breach(t.events, ["event_type"], "ts", "value", 1000.0, 20000)
    return out.withColumn("minutes_to_limit", F.coalesce("minutes_to_limit", F.lit(-1.0)))


# ---- windowed alerts; thresholds fit the scale of the events table

RULES = [
    slo.AlertRule("LatencyBreach", "latency_p95", True, 15.0, 7200),
    slo.AlertRule("LatencyWarning", "latency_p95", True, 10.0, 3600, "Sev-2"),
    slo.AlertRule("ErrorRateBreach", "error_ratio", True, 0.25, 3600),
    slo.AlertRule("ThroughputDrop", "events", False, 70, 0),
]
SLIDING = """(SELECT w AS window_start, event_id, ts, value, event_type FROM (SELECT *, unnest([date_trunc('hour', ts)::timestamp - to_hours(cast(i AS int)) for i in range(6)]) AS w FROM events))"""
METRICS = f"""(SELECT window_start, 'latency_p95' AS metric, round(quantile_cont(value, 0.95), 6) AS value FROM {SLIDING} GROUP BY 1
  UNION ALL SELECT window_start, 'error_ratio', cast(count(*) FILTER (WHERE event_type = 'error') AS double) / count(*) FROM {SLIDING} GROUP BY 1
  UNION ALL SELECT window_start, 'events', cast(count(*) AS double) FROM {SLIDING} GROUP BY 1)"""


def metrics(t: Tables):
    e = t.events
    plain = slo.window_metrics(
        e, "ts", [], "6 hours", "1 hour", {"error_ratio": F.count_if(F.col("event_type") == "error").cast("double") / F.count(F.lit(1)), "events": F.count(F.lit(1))}
    )
    return plain.unionByName(slo.window_quantile(e, "ts", [], "6 hours", "1 hour", "value", 0.95, "latency_p95"))


def settled(t: Tables):
    """The metrics, computed once: an alert looks at them more than once."""
    return cut_lineage(metrics(t))


@query("c15_window_metrics", f"SELECT * FROM {METRICS}")
def windowed(t: Tables):
    return metrics(t)


EVAL = f"""(SELECT r.alert, r.severity, r.f, m.window_start, CASE WHEN r.above THEN m.value > r.threshold ELSE m.value < r.threshold END AS breached FROM {METRICS} m JOIN (VALUES ('LatencyBreach','latency_p95',true,15.0,7200,'Sev-1'),('LatencyWarning','latency_p95',true,10.0,3600,'Sev-2'),
  ('ErrorRateBreach','error_ratio',true,0.25,3600,'Sev-1'),('ThroughputDrop','events',false,70.0,0,'Sev-1')) r(alert, metric, above, threshold, f, severity) ON r.metric = m.metric)"""


COMPOSITE = {"latency_p95": 10.0, "error_ratio": 0.2}
FIRED = f"""SELECT alert, severity, min(window_start) AS started, max(window_start) AS ended, count(*) AS samples, (epoch_us(max(window_start)) - epoch_us(min(window_start))) / 1e6 AS duration_s
     FROM (SELECT *, sum(CASE WHEN breached THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY window_start) AS b FROM {EVAL}) WHERE breached GROUP BY alert, severity, f, b HAVING (epoch_us(max(window_start)) - epoch_us(min(window_start))) / 1e6 >= f"""


@query("c15_fired_alerts", FIRED)
def fired(t: Tables):
    return slo.fired_alerts(slo.evaluate_rules(settled(t), RULES), [])


COMPOSED = f"""WITH w AS (SELECT window_start, max(value) FILTER (WHERE metric = 'latency_p95') p, max(value) FILTER (WHERE metric = 'error_ratio') e FROM {METRICS} GROUP BY 1),
     g AS (SELECT *, p > 10 AND e > 0.2 AS c, sum(CASE WHEN p > 10 AND e > 0.2 THEN 0 ELSE 1 END) OVER (ORDER BY window_start) AS b FROM w)
     SELECT min(window_start) AS started, max(window_start) AS ended, count(*) AS samples, (epoch_us(max(window_start)) - epoch_us(min(window_start))) / 1e6 AS duration_s FROM g WHERE c GROUP BY b HAVING (epoch_us(max(window_start)) - epoch_us(min(window_start))) / 1e6 >= 3600"""


@query("c16_composite_alert", COMPOSED)
def composite(t: Tables):
    return slo.composite_alert(settled(t), [], COMPOSITE, 3600)


@query(
    "c17_interval_rollup",
    """SELECT interval_start, event_type, n, total / n AS average, maximum, total FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts)::timestamp AS interval_start, event_type, count(*) AS n, cast(sum(cast(value AS decimal(18,2))) AS double) AS total, cast(max(value) AS double) AS maximum FROM events GROUP BY 1, 2)""",
)
def rollup(t: Tables):
    return slo.interval_rollup(t.events, "ts", ["event_type"], "value")
