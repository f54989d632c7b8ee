"""Inputs derived from the given tables, in Spark and as SQL text.

Drift, change feeds, job histories and the like are made by deterministic
expressions over the whole tables, so their size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.plans.registry import Tables

ORDER_COLS = ["id", "status", "total_amount", "updated_at", "is_deleted"]

SRC_ORDERS_EXPR = [
    "o_orderkey AS id",
    "o_orderstatus AS status",
    "CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount",
    "o_orderdate AS updated_at",
    "(o_orderkey % 97 = 0) AS is_deleted",
]
TGT_COLUMNS = [
    "CASE WHEN id % 613 = 11 THEN NULL ELSE status END AS status",
    "CAST(total_amount + CASE WHEN id % 501 = 3 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total_amount",
    "updated_at",
    "CASE WHEN id % 701 = 5 THEN NOT is_deleted ELSE is_deleted END AS is_deleted",
]


def src_orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*SRC_ORDERS_EXPR)


def tgt_orders(t: Tables, duplicates: bool = False) -> DataFrame:
    """Drifted copy: missing, changed, extra and (if asked) repeated rows, in one scan."""
    src = src_orders(t)
    copies = F.array(
        F.when(F.expr("id % 1000 <> 7"), F.col("id")),
        F.when(F.expr("id % 2000 = 3"), F.col("id") + 1000000000),
        F.when(F.expr("id % 1500 = 9") & F.lit(duplicates), F.col("id")),
    )
    return src.withColumn("copy_id", F.explode(F.array_compact(copies))).selectExpr("copy_id AS id", *TGT_COLUMNS)


SRC_ORDERS = f"(SELECT {', '.join(SRC_ORDERS_EXPR)} FROM orders)"


def tgt_orders_sql(duplicates: bool = False) -> str:
    cols = ", ".join(TGT_COLUMNS)
    parts = [
        f"SELECT id, {cols} FROM {SRC_ORDERS} WHERE id % 1000 <> 7",
        f"SELECT id + 1000000000 AS id, {cols} FROM {SRC_ORDERS} WHERE id % 2000 = 3",
    ]
    if duplicates:
        parts.append(f"SELECT id, {cols} FROM {SRC_ORDERS} WHERE id % 1500 = 9")
    return "(" + " UNION ALL ".join(parts) + ")"


TGT_ORDERS = tgt_orders_sql()
TGT_ORDERS_DUP = tgt_orders_sql(True)



def sized(text: str) -> str:
    return f"coalesce(length({text}) || ':' || ({text}), '~')"


CANON_FIELDS = [
    "cast(id AS varchar)",
    "trim(status)",
    "cast(total_amount AS varchar)",
    "strftime(updated_at,'%Y-%m-%d %H:%M:%S.%f')",
    "CASE WHEN is_deleted THEN '1' WHEN NOT is_deleted THEN '0' END",
]
CANON_ORDER = f"concat_ws('|', {', '.join(map(sized, CANON_FIELDS))})"


def md5_number(text: str) -> str:
    return f"cast('0x' || substr(md5({text}),1,15) AS bigint)"


ORDER_HASH = md5_number(CANON_ORDER)
KEY_HASH = md5_number(sized("cast(id AS varchar)"))

# change feed of the events table: seq, key, operation and a typed payload
CHANGES_EXPR = [
    "event_id AS seq",
    "user_id AS pk",
    "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op",
    "ts",
    "CAST(value AS DECIMAL(18,2)) AS amount",
    "event_type AS kind",
]
CHANGES = f"(SELECT {', '.join(CHANGES_EXPR)} FROM events)"


def changes(t: Tables) -> DataFrame:
    return t.events.selectExpr(*CHANGES_EXPR)


# the rows that exist before the feed is applied: every third user
USERS_EXPR = ["user_id AS pk", "CAST(0 AS DECIMAL(18,2)) AS amount", "'initial' AS kind"]
USERS = "(SELECT DISTINCT user_id AS pk, CAST(0 AS DECIMAL(18,2)) AS amount, 'initial' AS kind FROM events WHERE user_id % 3 = 0)"


def users(t: Tables) -> DataFrame:
    return t.events.where("user_id % 3 = 0").selectExpr(*USERS_EXPR).distinct()


LSN_SPARK = "lpad(lower(hex(event_id)), 20, '0')"
LSN_SQL = "lpad(lower(printf('%x', event_id)), 20, '0')"


def changes_coded(t: Tables) -> DataFrame:
    """Operation codes 1/2/4, with a before image (3) ahead of each 4."""
    e = t.events.selectExpr(f"{LSN_SPARK} AS lsn", *CHANGES_EXPR)
    code = F.when(F.col("op") == "D", 1).when(F.col("op") == "I", 2).otherwise(4)
    both = e.withColumn("code", code).withColumn(
        "code", F.explode(F.when(F.col("code") == 4, F.array(F.lit(3), F.lit(4))).otherwise(F.array("code")))
    )
    return both.select("lsn", "seq", F.when(F.col("seq") % 211 != 0, F.col("pk")).alias("pk"), "code", "ts", "amount", "kind")


CHANGES_CODED = f"""(
  WITH e AS (SELECT {LSN_SQL} AS lsn, *, CASE op WHEN 'D' THEN 1 WHEN 'I' THEN 2 ELSE 4 END AS c
             FROM (SELECT event_id, {', '.join(CHANGES_EXPR)} FROM events))
  SELECT lsn, seq, CASE WHEN seq % 211 <> 0 THEN pk END AS pk, c AS code, ts, amount, kind FROM e
  UNION ALL
  SELECT lsn, seq, CASE WHEN seq % 211 <> 0 THEN pk END AS pk, 3 AS code, ts, amount, kind FROM e WHERE c = 4)"""

# late copies move back two hours; exact replays repeat a row
CHANGES_LATE_EXPR = "CASE WHEN seq % 50 = 0 THEN ts - INTERVAL '2' HOUR ELSE ts END AS ts"


def changes_late(t: Tables) -> DataFrame:
    c = changes(t).selectExpr("seq", "pk", "op", CHANGES_LATE_EXPR, "amount", "kind")
    copies = F.when(F.expr("seq % 40 = 1"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.withColumn("arrival", F.explode(copies)).select("*", (F.col("seq") * 2 + F.col("arrival") * 101).alias("pos")).drop("arrival")


CHANGES_LATE = f"""(
  SELECT seq, pk, op, {CHANGES_LATE_EXPR}, amount, kind, seq * 2 AS pos FROM {CHANGES}
  UNION ALL
  SELECT seq, pk, op, {CHANGES_LATE_EXPR}, amount, kind, seq * 2 + 101 AS pos FROM {CHANGES} WHERE seq % 40 = 1)"""

HEALTH_EXPR = ["event_id AS id", "ts", "user_id AS target", "(event_type <> 'error') AS ok"]
HEALTH = f"(SELECT {', '.join(HEALTH_EXPR)} FROM events)"


def health(t: Tables) -> DataFrame:
    return t.events.selectExpr(*HEALTH_EXPR)


JOB_EXEC_EXPR = [
    "o_orderkey AS job_execution_id",
    "o_custkey AS job_id",
    "CASE o_orderstatus WHEN 'F' THEN 'Succeeded' WHEN 'O' THEN 'InProgress' ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'TimedOut' ELSE 'Failed' END) END AS lifecycle",
    "o_orderdate AS create_time",
    "o_orderdate AS start_time",
]


def job_executions(t: Tables) -> DataFrame:
    secs = F.expr("(o_orderkey % 23) * 60 + o_orderkey % 60")
    return t.orders.select(
        *[F.expr(x.rsplit(" AS ", 1)[0]).alias(x.rsplit(" AS ", 1)[1]) for x in JOB_EXEC_EXPR],
        F.when(F.col("o_orderstatus") != "O", F.timestamp_add("SECOND", secs, F.col("o_orderdate"))).alias("end_time"),
        F.expr("1 + o_orderkey % 3").alias("attempts"),
    )


JOB_EXECUTIONS = (
    f"(SELECT {', '.join(JOB_EXEC_EXPR)}, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds((o_orderkey % 23) * 60 + o_orderkey % 60) END AS end_time, "
    "1 + o_orderkey % 3 AS attempts FROM orders)"
)
JOBS = "(SELECT c_custkey AS job_id, c_name AS job_name FROM customer)"


def jobs(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey AS job_id", "c_name AS job_name")
