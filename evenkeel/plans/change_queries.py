"""Change feed of the events table: decoding, replay, checkpoints, order, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import positions as pos
from evenkeel.functions.segments import find_layout, running
from evenkeel.operators import ordered, replay as rp
from evenkeel.operators.compare import latest_by
from evenkeel.operators.remediate import merge_delta
from evenkeel.plans.derived import (
    CHANGES,
    CHANGES_CODED,
    CHANGES_LATE,
    HEALTH,
    JOB_EXECUTIONS,
    USERS,
    changes,
    changes_coded,
    changes_late,
    health,
    job_executions,
    users,
)
from evenkeel.plans.registry import Tables, query


def dbl(name: str):
    return F.col(name).cast("double").alias(name)


@query("p06_in_window", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS in_window FROM orders")
def window_flag(t: Tables):
    w = pos.in_window("o_orderdate", F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))
    return t.orders.select("o_orderkey", w.alias("in_window"))


FLAG = "CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN 'Y' WHEN 2 THEN 'true' WHEN 3 THEN 't' WHEN 4 THEN 'N' WHEN 5 THEN '0' ELSE NULL END"


@query(
    "p07_is_deleted",
    f"""SELECT o_orderkey, coalesce(f,'0') IN ('1','Y','true','t') AS postgresql, coalesce(f,'0') IN ('1','Y') AS mysql, coalesce(f,'0') IN ('1','Y') AS oracle, coalesce(f,'0') = '1' AS sqlserver
     FROM (SELECT o_orderkey, {FLAG} AS f FROM orders)""",
)
def deleted_flag(t: Tables):
    d = t.orders.selectExpr("o_orderkey", f"{FLAG} AS f")
    return d.select("o_orderkey", *[pos.is_deleted("f", e).alias(e) for e in pos.DELETED_TOKENS])


@query(
    "p12_decode_op",
    f"SELECT lsn, code, CASE code WHEN 1 THEN 'DELETE' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'UPDATE_BEFORE' WHEN 4 THEN 'UPDATE_AFTER' ELSE 'SKIP' END AS operation FROM {CHANGES_CODED}",
)
def decoded(t: Tables):
    return changes_coded(t).select("lsn", "code", pos.decode_op("code").alias("operation"))


LSN_RAW = "CASE WHEN event_id % 90 = 4 THEN 'zz' || lsn WHEN event_id % 70 = 3 THEN substr(lsn, 2) ELSE lsn END"


@query(
    "p13_valid_lsn",
    f"SELECT event_id, regexp_full_match({LSN_RAW}, '[0-9a-fA-F]{{20}}') AS valid FROM (SELECT event_id, lpad(printf('%x', event_id), 20, '0') AS lsn FROM events)",
)
def lsn_valid(t: Tables):
    raw = t.events.selectExpr("event_id", "lpad(lower(hex(event_id)), 20, '0') AS lsn").selectExpr("event_id", f"{LSN_RAW} AS l")
    return raw.select("event_id", pos.valid_lsn("l").alias("valid"))


@query(
    "p13_lsn_range",
    f"SELECT lsn, code FROM {CHANGES_CODED} WHERE seq > (SELECT max(event_id) // 10 FROM events) AND seq <= (SELECT max(event_id) // 2 FROM events)",
)
def lsn_between(t: Tables):
    return pos.lsn_range(changes_coded(t), "lsn", f"{position(t, 10):020x}", f"{position(t, 2):020x}").select("lsn", "code")


@query(
    "p14_serialise",
    """SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts,'%f') = '000000' THEN '' ELSE '.' || strftime(ts,'%f') END ||
      '","raw":"' || lower(hex(event_type)) || '","user_id":' || user_id || '}' AS value FROM events""",
)
def serialised(t: Tables):
    return pos.serialise(t.events.select("event_id", "ts", F.col("event_type").cast("binary").alias("raw"), "user_id"))


@query(
    "p15_lag_minutes",
    """SELECT event_id, (epoch_us(m) - epoch_us(ts)) / 6e7 AS lag_minutes, date_diff('minute', ts, m) AS lag_boundaries FROM events, (SELECT max(ts) m FROM events)""",
)
def lags(t: Tables):
    e = t.events.withColumn("m", t.events.agg(F.max("ts")).scalar())
    return e.select(
        "event_id",
        pos.lag_minutes(F.col("ts"), F.col("m")).alias("lag_minutes"),
        pos.lag_minute_boundaries(F.col("ts"), F.col("m")).alias("lag_boundaries"),
    )


# ---- net changes, windows of the feed, checkpoints


TENTH, HALF = "(SELECT max(event_id) // 10 FROM events)", "(SELECT max(event_id) // 2 FROM events)"


def position(t: Tables, part: int) -> int:
    """A log position at a fraction of the feed, as a caller would pass it."""
    return t.events.agg(F.max("event_id")).first()[0] // part


@query("c02_changes_between", f"SELECT seq, pk, op FROM {CHANGES} WHERE seq > {TENTH} AND seq <= {HALF} AND kind IN ('click','error')")
def between(t: Tables):
    return rp.changes_between(changes(t), "seq", position(t, 10), position(t, 2), ["click", "error"], "kind").select("seq", "pk", "op")


@query("w05_net_changes", f"SELECT pk, max(seq) AS seq, arg_max(op, seq) AS op, cast(arg_max(amount, seq) AS double) AS amount FROM {CHANGES} GROUP BY pk")
def net(t: Tables):
    return rp.net_changes(changes(t), ["pk"], "seq").select("pk", "seq", "op", dbl("amount"))


def replay_sql(conflict: str, feed: str = CHANGES, select: str = "final") -> str:
    """Window form of ordered replay for one policy."""
    upsert = "true" if conflict == "UPSERT" else "false"
    return f"""WITH c AS (SELECT * FROM {feed}),
      ev AS (SELECT pk, seq + 1 AS p, op, amount, kind, true AS ca, true AS ck FROM c UNION ALL SELECT u.pk, 0, 'B', u.amount, u.kind, true, true FROM {USERS} u WHERE u.pk IN (SELECT pk FROM c)),
      x AS (SELECT *, coalesce(max(CASE WHEN op IN ('B','I','D') THEN p * 2 + (CASE WHEN op <> 'D' THEN 1 ELSE 0 END) END) OVER (PARTITION BY pk ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1, false) AS eb FROM ev),
      y AS (SELECT *, (op = 'B' OR (op = 'I' AND NOT eb)) AS creating, (op = 'U' AND eb) OR (op = 'I' AND eb AND {upsert}) AS upd FROM x),
      final AS (SELECT pk, cast(arg_max(amount, p) FILTER (WHERE creating OR upd) AS double) AS amount, arg_max(kind, p) FILTER (WHERE creating OR upd) AS kind
        FROM y GROUP BY pk HAVING arg_max(op, p) FILTER (WHERE op IN ('B','I','D')) <> 'D'
        UNION ALL SELECT pk, cast(amount AS double), kind FROM {USERS} WHERE pk NOT IN (SELECT pk FROM c)),
      outcomes AS (SELECT CASE WHEN op = 'I' AND eb THEN '{'upserted' if conflict == 'UPSERT' else 'conflict_skipped'}' WHEN op = 'I' THEN 'inserted' WHEN NOT eb THEN 'missing_skipped' WHEN op = 'U' THEN 'updated' ELSE 'deleted' END AS outcome, count(*) AS changes FROM y WHERE op <> 'B' GROUP BY 1)
      SELECT * FROM {select}"""


@query("c03_replay_skip", replay_sql("SKIP"))
def replayed(t: Tables):
    return rp.replay(users(t), changes(t), ["pk"]).select("pk", dbl("amount"), "kind")


@query("c11_replay_upsert_policy", replay_sql("UPSERT"))
def replayed_upsert(t: Tables):
    return rp.replay(users(t), changes(t), ["pk"], policy=rp.Policy("UPSERT")).select("pk", dbl("amount"), "kind")


@query("c03_replay_outcomes", replay_sql("SKIP", select="outcomes"))
def outcomes(t: Tables):
    return rp.replay_outcomes(users(t), changes(t), ["pk"])


CARRIED_SPARK = "CASE kind WHEN 'view' THEN array('kind') WHEN 'click' THEN array('amount') ELSE array('amount','kind') END AS cols"


@query(
    "c03_replay_partial_columns",
    f"""WITH ev AS (SELECT pk, seq + 1 AS p, op, amount, kind, kind <> 'view' AS ca, kind <> 'click' AS ck FROM {CHANGES} UNION ALL SELECT pk, 0, 'B', amount, kind, true, true FROM {USERS}),
      x AS (SELECT *, coalesce(max(CASE WHEN op IN ('B','I','D') THEN p * 2 + (CASE WHEN op <> 'D' THEN 1 ELSE 0 END) END) OVER (PARTITION BY pk ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1, false) AS eb FROM ev),
      y AS (SELECT *, (op = 'B' OR (op = 'I' AND NOT eb)) AS creating, (op = 'U' AND eb) AS upd FROM x)
      SELECT pk, cast(arg_max(amount, p) FILTER (WHERE creating OR (upd AND ca)) AS double) AS amount, arg_max(kind, p) FILTER (WHERE creating OR (upd AND ck)) AS kind
      FROM y GROUP BY pk HAVING arg_max(op, p) FILTER (WHERE op IN ('B','I','D')) <> 'D'""",
)
def replayed_partial(t: Tables):
    feed = changes(t).selectExpr("*", CARRIED_SPARK)
    return rp.replay(users(t), feed, ["pk"], carried="cols").select("pk", dbl("amount"), "kind")


@query(
    "c04_replay_upsert",
    f"SELECT coalesce(u.pk, n.pk) AS pk, coalesce(n.amount, cast(u.amount AS double)) AS amount, coalesce(n.kind, u.kind) AS kind FROM {USERS} u FULL OUTER JOIN (SELECT pk, cast(arg_max(amount, seq) AS double) amount, arg_max(kind, seq) kind FROM {CHANGES} GROUP BY pk) n ON u.pk = n.pk",
)
def upserted(t: Tables):
    return rp.replay_upsert(users(t), changes(t), ["pk"]).select("pk", dbl("amount"), "kind")


CODED_FEED = f"(SELECT seq, pk, CASE code WHEN 1 THEN 'D' WHEN 2 THEN 'I' ELSE 'U' END AS op, amount, kind FROM {CHANGES_CODED} WHERE code <> 3 AND pk IS NOT NULL)"


@query("c05_replay_coded", replay_sql("UPSERT", CODED_FEED))
def coded(t: Tables):
    return rp.replay_coded(users(t), changes_coded(t).drop("lsn", "ts"), "pk").select("pk", dbl("amount"), "kind")


# transactions of eight changes share a log position; before and after images share place and position
LSN_SEQVAL = "lpad(lower(hex(seq div 8)), 20, '0') AS lsn", "lpad(lower(hex(seq % 8)), 20, '0') AS seqval"
COMPOSITE_FEED = f"(SELECT ((seq // 8) * 8 + seq % 8) * 8 + code AS seq, pk, CASE code WHEN 1 THEN 'D' WHEN 2 THEN 'I' ELSE 'U' END AS op, amount, kind FROM {CHANGES_CODED} WHERE code <> 3 AND pk IS NOT NULL)"


@query("c05_lsn_seqval", replay_sql("UPSERT", COMPOSITE_FEED))
def coded_positions(t: Tables):
    feed = changes_coded(t).drop("lsn").selectExpr("*", *LSN_SEQVAL)
    placed = feed.withColumn("position", pos.composite("lsn", "seqval", "code")).drop("lsn", "seqval", "seq", "ts")
    return rp.replay_coded(users(t), placed, "pk", "position").select("pk", dbl("amount"), "kind")


@query(
    "c06_merge_delta",
    f"""WITH d AS (SELECT pk, arg_max(op, seq) op, arg_max(amount, seq) amount, arg_max(kind, seq) kind FROM {CHANGES} GROUP BY pk)
     SELECT coalesce(u.pk, d.pk) AS pk, cast(CASE WHEN d.op IN ('I','U') THEN d.amount ELSE u.amount END AS double) AS amount, CASE WHEN d.op IN ('I','U') THEN d.kind ELSE u.kind END AS kind
     FROM {USERS} u FULL OUTER JOIN d ON u.pk = d.pk WHERE d.op IS NULL OR d.op <> 'D'""",
)
def merged(t: Tables):
    delta = rp.net_changes(changes(t), ["pk"], "seq").select("pk", F.col("op").alias("op_type"), "amount", "kind")
    return merge_delta(users(t), delta, "pk").select("pk", dbl("amount"), "kind")


@query("c07_checkpoint", f"SELECT kind, max(seq) AS last_seq, max(ts) AS last_timestamp, count(*) AS rows_applied FROM {CHANGES} GROUP BY kind")
def marks(t: Tables):
    c = changes(t)
    half = position(t, 2)
    first, second = c.where(F.col("seq") < half), c.where(F.col("seq") >= half)
    return rp.merge_checkpoint(rp.checkpoint_of(first, "kind", "seq", "ts"), rp.checkpoint_of(second, "kind", "seq", "ts"), "kind")


@query("c08_shared_position", f"SELECT seq // 4 AS position, pk, op, seq FROM {CHANGES} WHERE seq // 4 > {HALF} // 4")
def shared_positions(t: Tables):
    """Four changes at each position; the feed repeats some of them."""
    c = changes(t).select(F.expr("seq div 4").alias("position"), "pk", "op", "seq", F.lit("users").alias("table"))
    mark = c.where(F.col("position") <= position(t, 2) // 4).groupBy("table").agg(F.max("position").alias("last_seq"))
    return rp.skip_applied(c.unionByName(c.where("seq % 40 = 1")), mark, "table", "position").select("position", "pk", "op", "seq")


@query("c08_skip_applied", f"SELECT seq, pk, op FROM {CHANGES} c WHERE seq > (SELECT max(seq) FROM {CHANGES} m WHERE m.kind = c.kind AND m.seq < {HALF})")
def resumed(t: Tables):
    c = changes(t)
    mark = rp.checkpoint_of(c.where(F.col("seq") < position(t, 2)), "kind", "seq", "ts")
    return rp.skip_applied(c.unionByName(c.where("seq % 40 = 1")), mark, "kind", "seq").select("seq", "pk", "op")


@query(
    "c12_order_tables",
    "SELECT DISTINCT p_brand AS table_name, CASE p_brand WHEN 'Brand#7' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 3 END AS priority_rank, CASE p_brand WHEN 'Brand#5' THEN 1 ELSE 0 END AS dependency_level FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2')",
)
def ordered_tables(t: Tables):
    tables = t.part.select(F.col("p_brand").alias("table_name")).distinct()
    return rp.order_tables(tables, "table_name", ["Brand#1", "Brand#2"], ["Brand#7", "Brand#3"], {"Brand#5": 1})


# each brand refers to two brands below it; four brands refer to each other in a circle, and some stand behind it
LINKS_SQL = """(SELECT DISTINCT p_brand AS table_name, 'Brand#' || (b // 2) AS parent FROM (SELECT p_brand, cast(substr(p_brand, 7) AS int) AS b FROM part) WHERE b // 2 <> b AND b // 2 > 0
  UNION SELECT DISTINCT p_brand, 'Brand#' || (b // 3) FROM (SELECT p_brand, cast(substr(p_brand, 7) AS int) AS b FROM part) WHERE b // 3 > 0
  UNION SELECT DISTINCT p_brand, 'Brand#' || (b + 2) FROM (SELECT p_brand, cast(substr(p_brand, 7) AS int) AS b FROM part) WHERE b = 5)"""


@query(
    "c12_dependency_levels",
    f"""WITH RECURSIVE link AS (SELECT DISTINCT table_name, parent FROM {LINKS_SQL}), every AS (SELECT DISTINCT p_brand AS table_name FROM part UNION SELECT table_name FROM link UNION SELECT parent FROM link),
     walk AS (SELECT table_name, 0 AS d FROM every UNION SELECT l.table_name, w.d + 1 FROM walk w JOIN link l ON l.parent = w.table_name WHERE w.d < 60)
     SELECT table_name, CASE WHEN max(d) < 60 THEN max(d) END::INT AS dependency_level, max(d) < 60 AS in_order FROM walk GROUP BY table_name""",
)
def levels(t: Tables):
    b = t.part.select(F.col("p_brand").alias("table_name"), F.substring("p_brand", 7, 9).cast("int").alias("b")).distinct()
    pairs = b.select("table_name", F.explode(F.array(F.expr("b div 2"), F.expr("b div 3"), F.expr("CASE WHEN b = 5 THEN cast(b + 2 AS bigint) ELSE 0 END"))).alias("p")).where("p > 0")
    links = pairs.select("table_name", F.concat(F.lit("Brand#"), F.col("p").cast("string")).alias("parent"))
    return rp.dependency_levels(b.select("table_name"), links, "table_name", "parent")


@query(
    "c13_cdc_health",
    f"""WITH k AS (SELECT pk, max(seq) last_seq, max(ts) lt, count(*) n, count(*) FILTER (WHERE op = 'D') f FROM {CHANGES} GROUP BY pk), m AS (SELECT max(ts) m FROM events),
     h AS (SELECT pk, (epoch_us(m) - epoch_us(lt)) / 6e7 AS lag_minutes, cast(f AS double) / n AS error_rate FROM k, m)
     SELECT *, CASE WHEN lag_minutes > 15 THEN 'ALERT' WHEN lag_minutes > 5 THEN 'WARN' ELSE 'OK' END AS lag_state, CASE WHEN error_rate > 0.01 THEN 'ALERT' ELSE 'OK' END AS error_state FROM h""",
)
def feed_health(t: Tables):
    c = changes(t)
    mark = c.groupBy("pk").agg(F.max("seq").alias("last_seq"), F.max("ts").alias("last_timestamp"), F.count(F.lit(1)).alias("rows_applied"), F.count_if(F.col("op") == "D").alias("failed"))
    return rp.cdc_health(mark, c.agg(F.max("ts").alias("as_of"))).select("pk", "lag_minutes", "error_rate", "lag_state", "error_state")


@query(
    "c14_late_changes",
    f"""SELECT pos, seq, pk, coalesce(ts < max(ts) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE, false) AS late,
     row_number() OVER (PARTITION BY pk, seq ORDER BY pos) > 1 AS duplicate FROM {CHANGES_LATE}""",
)
def late(t: Tables):
    return rp.late_changes(changes_late(t), ["pk"], "seq", "ts", "pos", 600).select("pos", "seq", "pk", "late", "duplicate")


@query(
    "c14_missing_positions",
    f"""SELECT kind, prev + 1 AS first_missing, p - 1 AS last_missing, p - prev - 1 AS missing FROM (SELECT kind, p, lag(p) OVER (PARTITION BY kind ORDER BY p) AS prev
     FROM (SELECT DISTINCT kind, seq // 4 AS p FROM {CHANGES} WHERE seq % 100 >= 30 OR seq % 1000 < 500)) WHERE p - prev > 1""",
)
def missing(t: Tables):
    """Three batches: early ones, a jump ahead that leaves holes, and late files that fill some and repeat others."""
    came = changes(t).where("seq % 100 >= 30 OR seq % 1000 < 500").select("kind", F.expr("seq div 4").alias("p"), "seq")
    half = position(t, 2)
    batches = [came.where(F.col("seq") < half // 2), came.where(F.col("seq") >= half), came.where(F.col("seq") < half)]
    intervals = rp.position_intervals(batches[0], "kind", "p")
    for batch in batches[1:]:
        intervals = rp.merge_intervals(intervals.unionByName(rp.position_intervals(batch, "kind", "p")), "kind")
    return rp.missing_positions(intervals, "kind")


@query("c18_shadow_sync", replay_sql("UPSERT").replace("SELECT * FROM final", "SELECT pk, cast(cast(amount * 100 AS decimal(20,0)) AS bigint) AS amount_cents, upper(kind) AS kind_code FROM final"))
def shadow(t: Tables):
    new = {"amount_cents": (F.col("amount") * 100).cast("long"), "kind_code": F.upper("kind")}
    return rp.shadow_sync(users(t), changes(t), new, "pk")


# ---- order-dependent calculations


@query("w01_latest", f"SELECT job_id, job_execution_id, lifecycle, create_time FROM {JOB_EXECUTIONS} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY create_time DESC, job_execution_id DESC) = 1")
def latest(t: Tables):
    return latest_by(job_executions(t), ["job_id"], ["create_time", "job_execution_id"]).select("job_id", "job_execution_id", "lifecycle", "create_time")


@query("w02_pct_of_total", "SELECT event_type, v AS total_value, cast(cast(v * 100.0::double / sum(v) OVER () AS decimal(8,2)) AS double) AS pct FROM (SELECT event_type, cast(sum(cast(value AS decimal(18,2))) AS double) v FROM events GROUP BY 1)")
def shares(t: Tables):
    per = t.events.groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"))
    return ordered.pct_of_total(per, "total_value")


@query(
    "w03_heartbeat",
    f"""WITH g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY ts, id) AS grp FROM {HEALTH}),
      s AS (SELECT id, target, ok, cast(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY target, grp ORDER BY ts, id) AS bigint) AS streak FROM g)
     SELECT id, target, streak, streak >= 3 AS alarm FROM s""",
)
def beats(t: Tables):
    return ordered.heartbeat(health(t), "target", ["ts", "id"], "ok").select("id", "target", "streak", "alarm")


COUNTER = "(SELECT event_id, user_id, ts, sum(cast(value AS decimal(18,2))) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS counter FROM events)"


def by_user(t: Tables):
    """One look at the table serves every ordered step per user."""
    return find_layout(t.events, ["user_id"], "ts")


def counters(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", F.date_trunc("week", "ts").alias("week"), F.col("value").cast("decimal(18,2)").alias("v"))
    return running(e, ["user_id", "week"], ["ts", "event_id"], {"counter": ("sum", F.col("v"))}, layout=by_user(t)).select("event_id", "user_id", "ts", "counter")


DELTA = f"(SELECT *, CASE WHEN p IS NULL THEN NULL WHEN counter < p THEN counter ELSE counter - p END AS delta FROM (SELECT *, lag(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {COUNTER}))"


@query("w04_snapshot_delta", f"SELECT event_id, user_id, cast(counter AS double) AS counter, coalesce(cast(delta AS double), -1) AS delta FROM {DELTA}")
def deltas(t: Tables):
    out = ordered.snapshot_delta(counters(t), ["user_id"], ["ts", "event_id"], "counter", by_user(t))
    return out.select("event_id", "user_id", dbl("counter"), F.coalesce(F.col("delta").cast("double"), F.lit(-1.0)).alias("delta"))


@query(
    "w06_sequence_gaps",
    """SELECT p + 1 AS gap_start, event_id - 1 AS gap_end, event_id - p - 1 AS missing FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p
     FROM events WHERE event_id % 333 <> 10 AND event_id NOT BETWEEN 500 AND 509) WHERE event_id - p > 1""",
)
def gaps(t: Tables):
    return ordered.sequence_gaps(t.events.where("event_id % 333 <> 10 AND event_id NOT BETWEEN 500 AND 509"), "event_id")


@query(
    "w07_sustained",
    """WITH g AS (SELECT *, value > 5 AS c, sum(CASE WHEN value > 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
     SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM g WHERE c GROUP BY user_id, b
     HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 120""",
)
def lasting(t: Tables):
    return ordered.sustained(t.events, ["user_id"], ["ts", "event_id"], F.col("value") > 5, 120)


@query(
    "w08_rate",
    f"SELECT event_id, user_id, cast(sum(coalesce(delta, 0)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS double) / 21600 AS rate FROM {DELTA}",
)
def rates(t: Tables):
    return ordered.rate(counters(t), ["user_id"], ["ts", "event_id"], "counter", 21600, by_user(t)).select("event_id", "user_id", "rate")


@query(
    "w09_wow_regression",
    """WITH w AS (SELECT event_type, date_trunc('week', ts)::timestamp AS week, quantile_cont(value, 0.99) AS p FROM events GROUP BY 1, 2),
      c AS (SELECT *, round((p - lag(p) OVER (PARTITION BY event_type ORDER BY week)) * 100.0::double / lag(p) OVER (PARTITION BY event_type ORDER BY week), 4) AS ch FROM w)
     SELECT event_type, week, round(p, 6) AS p99, coalesce(ch, 0) AS change_pct, coalesce(ch > 20, false) AS regressed FROM c""",
)
def weekly(t: Tables):
    out = ordered.wow_regression(t.events, "ts", "value", ["event_type"])
    return out.withColumn("change_pct", F.coalesce("change_pct", F.lit(0.0)))


@query(
    "w10_size_drop",
    """SELECT event_id, user_id, value, a AS avg_before FROM (SELECT *, cast(sum(cast(value AS decimal(18,2))) OVER w AS double) / count(*) OVER w AS a FROM events
     WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE value < a * 0.5""",
)
def drops(t: Tables):
    return ordered.size_drop(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value", "avg_before")


@query("w12_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def tops(t: Tables):
    return ordered.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))
