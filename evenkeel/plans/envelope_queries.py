"""One feed that changes three tables: users, accounts and shelves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evenkeel.operators.envelope import Replayed, Target, replay_envelopes
from evenkeel.operators.replay import Policy
from evenkeel.plans.derived import CHANGES, USERS, changes, users
from evenkeel.plans.registry import Tables, query

OPERATION = "CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END"
ACCOUNT_OP = "CASE o_orderstatus WHEN 'F' THEN 'I' WHEN 'O' THEN 'U' ELSE 'D' END"
SHELF_OP = "CASE WHEN quantity % 5 < 2 THEN 'I' WHEN quantity % 5 >= 4 THEN 'D' ELSE 'U' END"


def line(op, table, scn, ts, pk, data):
    """One change as JSON text; null fields are left out."""
    return F.to_json(F.struct(op.alias("operation"), table.alias("table"), scn.alias("scn"), ts.alias("timestamp"), pk.alias("pk"), data.alias("data")))


def user_lines(t: Tables) -> DataFrame:
    """Unknown operations and tables, cut lines, lines without a position, lines that come twice."""
    c = changes(t)
    op = F.when(F.expr("seq % 101 = 0"), "TRUNCATE").otherwise(F.expr(OPERATION))
    table = F.when(F.expr("seq % 107 = 2"), "nowhere").otherwise("users")
    scn = F.when(F.expr("seq % 113 <> 3"), F.col("seq"))
    data = F.struct("pk", F.expr("CASE WHEN kind <> 'view' THEN amount END AS amount"), F.expr("CASE WHEN kind <> 'click' THEN kind END AS kind"))
    value = line(op, table, scn, F.col("ts"), F.struct("pk"), data)
    cut = F.when(F.expr("seq % 103 = 1"), F.left(value, F.lit(20))).otherwise(value)
    twice = F.when(F.expr("seq % 97 = 5"), 2).otherwise(1)
    return c.select(cut.alias("value"), F.explode(F.array_repeat(F.lit(0).cast("long"), twice)).alias("place"))


def account_lines(t: Tables) -> DataFrame:
    """Updates of single columns, amounts that are no numbers."""
    o = t.orders.withColumn("op", F.expr(ACCOUNT_OP))
    balance = F.expr("CASE WHEN o_orderkey % 109 = 0 THEN 'n/a' WHEN op <> 'U' OR o_orderkey % 3 <> 1 THEN cast(cast(o_totalprice AS decimal(18,2)) AS string) END")
    since = F.expr("CASE WHEN op <> 'U' OR o_orderkey % 3 <> 0 THEN o_orderdate END")
    key = F.struct(F.col("o_custkey").alias("id"))
    data = F.struct(F.col("o_custkey").alias("id"), balance.alias("balance"), since.alias("since"))
    return o.select(line(F.expr(OPERATION), F.lit("accounts"), F.col("o_orderkey"), F.col("o_orderdate"), key, data).alias("value"), F.lit(0).cast("long").alias("place"))


def shelf_rows(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"), F.max("l_shipdate").alias("seen"))


def shelf_lines(t: Tables) -> DataFrame:
    """A key of two columns; changes of one order share their scn."""
    rows = shelf_rows(t).withColumn("op", F.expr(SHELF_OP))
    key = F.struct(F.expr("l_orderkey div 4 AS shelf"), F.col("l_linenumber").alias("slot"))
    data = F.struct(F.expr("l_orderkey div 4 AS shelf"), F.col("l_linenumber").alias("slot"), "quantity", "seen")
    return rows.select(
        line(F.expr(OPERATION), F.lit("shelves"), F.col("l_orderkey"), F.col("seen"), key, data).alias("value"), F.col("l_linenumber").cast("long").alias("place")
    )


def targets(t: Tables) -> dict[str, Target]:
    accounts = t.customer.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS id", "CAST(c_acctbal AS DECIMAL(18,2)) AS balance", "TIMESTAMP_NTZ '1990-01-01 00:00:00' AS since")
    shelves = shelf_rows(t).where("l_orderkey div 4 % 2 = 0").selectExpr(
        "l_orderkey div 4 AS shelf", "l_linenumber AS slot", "CAST(-1 AS DOUBLE) AS quantity", "TIMESTAMP_NTZ '1990-01-01 00:00:00' AS seen"
    )
    return {"users": Target(users(t), ("pk",)), "accounts": Target(accounts, ("id",), Policy("UPSERT")), "shelves": Target(shelves.distinct(), ("shelf", "slot"))}


def run(t: Tables) -> Replayed:
    feed = reduce(DataFrame.unionByName, [user_lines(t), account_lines(t), shelf_lines(t)])
    return replay_envelopes(feed, targets(t), place="place")


USER_FAULT = "(seq % 101 = 0 OR seq % 103 = 1 OR seq % 107 = 2 OR seq % 113 = 3)"
ACCOUNT_FAULT = "(o_orderkey % 109 = 0 AND o_orderstatus <> 'P')"


def envelope_sql(select: str) -> str:
    return f"""WITH shelf AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity, max(l_shipdate) AS seen FROM lineitem GROUP BY ALL),
      ev AS (
        SELECT 'users' AS "table", cast(pk AS varchar) AS key, seq + 1 AS p, op, cast(amount AS double) AS v1, kind AS v2, kind <> 'view' AS c1, kind <> 'click' AS c2 FROM {CHANGES} WHERE NOT {USER_FAULT}
        UNION ALL SELECT 'users', cast(pk AS varchar), 0, 'B', cast(amount AS double), kind, true, true FROM {USERS}
        UNION ALL SELECT 'accounts', cast(o_custkey AS varchar), o_orderkey + 1, {ACCOUNT_OP}, cast(cast(o_totalprice AS decimal(18,2)) AS double), strftime(o_orderdate, '%Y-%m-%d'),
          o_orderstatus <> 'O' OR o_orderkey % 3 <> 1, o_orderstatus <> 'O' OR o_orderkey % 3 <> 0 FROM orders WHERE NOT {ACCOUNT_FAULT}
        UNION ALL SELECT 'accounts', cast(c_custkey AS varchar), 0, 'B', cast(cast(c_acctbal AS decimal(18,2)) AS double), '1990-01-01', true, true FROM customer WHERE c_custkey % 4 <> 0
        UNION ALL SELECT 'shelves', concat(l_orderkey // 4, '/', l_linenumber), (l_orderkey + 1) * 10 + l_linenumber, {SHELF_OP}, quantity, strftime(seen, '%Y-%m-%d'), true, true FROM shelf
        UNION ALL SELECT DISTINCT 'shelves', concat(l_orderkey // 4, '/', l_linenumber), 0, 'B', -1, '1990-01-01', true, true FROM shelf WHERE l_orderkey // 4 % 2 = 0),
      x AS (SELECT *, coalesce(max(CASE WHEN op IN ('B','I','D') THEN p * 2 + (CASE WHEN op <> 'D' THEN 1 ELSE 0 END) END)
        OVER (PARTITION BY "table", key ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1, false) AS eb FROM ev),
      y AS (SELECT *, op = 'B' OR (op = 'I' AND NOT eb) AS creating, eb AND (op = 'U' OR (op = 'I' AND "table" = 'accounts')) AS upd FROM x),
      final AS (SELECT "table", key, arg_max(v1, p) FILTER (WHERE creating OR (upd AND c1)) AS v1, arg_max(v2, p) FILTER (WHERE creating OR (upd AND c2)) AS v2
        FROM y GROUP BY "table", key HAVING arg_max(op, p) FILTER (WHERE op IN ('B','I','D')) <> 'D'),
      wrong AS (
        SELECT CASE WHEN seq % 103 = 1 THEN NULL WHEN seq % 107 = 2 THEN 'nowhere' ELSE 'users' END AS "table", CASE WHEN seq % 97 = 5 THEN 2 ELSE 1 END AS n FROM {CHANGES} WHERE {USER_FAULT}
        UNION ALL SELECT 'accounts', 1 FROM orders WHERE {ACCOUNT_FAULT}),
      counts AS (
        SELECT "table", CASE WHEN op = 'I' AND NOT eb THEN 'inserted' WHEN op = 'I' THEN CASE WHEN "table" = 'accounts' THEN 'upserted' ELSE 'conflict_skipped' END
          WHEN NOT eb THEN 'missing_skipped' WHEN op = 'U' THEN 'updated' ELSE 'deleted' END AS outcome, count(*) AS changes FROM y WHERE op <> 'B' GROUP BY ALL
        UNION ALL SELECT "table", 'rejected', sum(n)::BIGINT FROM wrong GROUP BY ALL)
      SELECT * FROM {select}"""


@query("c03_envelope_replay", envelope_sql("final"))
def envelope_replay(t: Tables):
    done = run(t).tables
    forms = {"users": ("cast(pk AS string)", "amount", "kind"), "accounts": ("cast(id AS string)", "balance", "date_format(since, 'yyyy-MM-dd')")}
    forms["shelves"] = ("concat(shelf, '/', slot)", "quantity", "date_format(seen, 'yyyy-MM-dd')")
    out = [done[name].selectExpr(f"'{name}' AS table", f"{k} AS key", f"cast({a} AS double) AS v1", f"{b} AS v2") for name, (k, a, b) in forms.items()]
    return reduce(DataFrame.unionByName, out)


@query("c03_envelope_counts", envelope_sql("counts"))
def envelope_counts(t: Tables):
    return run(t).counts
