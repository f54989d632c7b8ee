"""Contracts, drift, audits and hygiene over rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import quality as q
from evenkeel.plans.derived import ORDER_COLS, ORDER_HASH, SRC_ORDERS, TGT_ORDERS, src_orders, tgt_orders
from evenkeel.plans.registry import Tables, query


@query("q09_keys_present", "SELECT bool_and(json_exists(props, '$.k')) AS all_present, 'k' AS key FROM events UNION ALL SELECT bool_and(json_exists(props, '$.z')), 'z' FROM events")
def keys(t: Tables):
    a = q.keys_present(t.events, "props", "k").withColumn("key", F.lit("k"))
    return a.unionByName(q.keys_present(t.events, "props", "z").withColumn("key", F.lit("z")))


RAW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 5 THEN 'n/a' WHEN o_orderkey % 211 = 3 THEN NULL ELSE cast(o_orderkey AS varchar) END AS order_id, CASE WHEN o_orderkey % 89 = 7 THEN '12,5' ELSE cast(o_custkey AS varchar) END AS price FROM orders)"


def raw_orders(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 101 = 5 THEN 'n/a' WHEN o_orderkey % 211 = 3 THEN NULL ELSE cast(o_orderkey AS string) END AS order_id",
        "CASE WHEN o_orderkey % 89 = 7 THEN '12,5' ELSE cast(o_custkey AS string) END AS price",
    )


@query(
    "q10_check_contract",
    f"""SELECT o_orderkey, reason, reason = '' AS valid FROM (SELECT o_orderkey, concat_ws('; ', CASE WHEN order_id IS NULL THEN 'order_id: missing' WHEN try_cast(order_id AS int) IS NULL THEN 'order_id: not int' END,
      CASE WHEN price IS NULL THEN 'price: missing' WHEN try_cast(price AS double) IS NULL THEN 'price: not double' END) AS reason FROM {RAW})""",
)
def contract(t: Tables):
    return q.check_contract(raw_orders(t), {"order_id": "int", "price": "double"}).select("o_orderkey", "reason", "valid")


COLS_SPARK = ["p_brand AS table_name", "concat('c', p_partkey) AS column_name"]
OLD_TYPE = "CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'double' ELSE 'string' END"
NEW_TYPE = "CASE WHEN p_partkey % 7 = 2 THEN 'bigint' WHEN p_partkey % 11 = 3 THEN 'int' ELSE {} END".format(OLD_TYPE)


@query(
    "q11_schema_drift",
    f"""WITH o AS (SELECT p_brand AS table_name, 'c' || p_partkey AS column_name, {OLD_TYPE} AS old_type FROM part WHERE p_partkey % 13 <> 1),
      n AS (SELECT p_brand AS table_name, 'c' || p_partkey AS column_name, {NEW_TYPE} AS new_type FROM part WHERE p_partkey % 17 <> 1),
      b AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name, old_type, new_type FROM o FULL OUTER JOIN n ON o.table_name = n.table_name AND o.column_name = n.column_name)
     SELECT table_name, column_name, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'retyped' END AS change,
       old_type IS NULL OR (new_type IS NOT NULL AND concat(old_type, '>', new_type) IN ('int>bigint','float>double','int>double','smallint>int','tinyint>int','date>timestamp')) AS compatible
     FROM b WHERE old_type IS DISTINCT FROM new_type""",
)
def drift(t: Tables):
    old = t.part.where("p_partkey % 13 <> 1").selectExpr(*COLS_SPARK, f"{OLD_TYPE} AS data_type")
    new = t.part.where("p_partkey % 17 <> 1").selectExpr(*COLS_SPARK, f"{NEW_TYPE} AS data_type")
    return q.schema_drift(old, new, ["table_name", "column_name"]).select("table_name", "column_name", "change", "compatible")


@query(
    "q12_freshness",
    """SELECT user_id, newest, (epoch_us(m) - epoch_us(newest)) / 6e7 AS lag_minutes, CASE WHEN (epoch_us(m) - epoch_us(newest)) / 6e7 <= 600 THEN 'FRESH' ELSE 'STALE' END AS status
     FROM (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1), (SELECT max(ts) m FROM events)""",
)
def fresh(t: Tables):
    return q.freshness(t.events, "ts", ["user_id"], 600, t.events.agg(F.max("ts").alias("as_of")))


AUDIT_TYPE = "CASE p_size % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'ntext' WHEN 2 THEN 'unknown' WHEN 3 THEN 'geometry' ELSE 'bigint' END"


@query(
    "q13_type_audit",
    f"SELECT p_partkey, data_type, CASE WHEN data_type IN ('text','ntext','image','sql_variant','hierarchyid','geography','geometry') THEN 'UNSUPPORTED' WHEN data_type = 'unknown' THEN 'UNKNOWN' ELSE 'OK' END AS audit FROM (SELECT p_partkey, {AUDIT_TYPE} AS data_type FROM part)",
)
def audit(t: Tables):
    return q.type_audit(t.part.selectExpr("p_partkey", f"{AUDIT_TYPE} AS data_type"))


@query("q14_not_null_violations", f"SELECT 'status' AS column_name, count(*) AS null_count FROM {TGT_ORDERS} WHERE status IS NULL HAVING count(*) > 0")
def not_null(t: Tables):
    return q.not_null_violations(tgt_orders(t), ["id", "status", "total_amount"])


@query(
    "q15_restore_check",
    f"""WITH p AS (SELECT count(*) n, max(id) m, sum({ORDER_HASH}) h FROM {SRC_ORDERS}), r AS (SELECT count(*) n, max(id) m, sum({ORDER_HASH}) h FROM {TGT_ORDERS}),
      v AS (SELECT round(abs(r.n - p.n) * 100.0::double / p.n, 4) AS v, r.h AS rh, p.h AS ph, r.m AS rm, p.m AS pm FROM p, r)
     SELECT 'ROW_VARIANCE' AS check_name, cast(v AS varchar) AS observed, CASE WHEN v < 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM v
     UNION ALL SELECT 'CHECKSUM', cast(rh AS varchar), CASE WHEN rh = ph THEN 'PASS' ELSE 'FAIL' END FROM v
     UNION ALL SELECT 'MAX_ID', cast(rm AS varchar), CASE WHEN rm = pm THEN 'PASS' ELSE 'FAIL' END FROM v""",
)
def restored(t: Tables):
    return q.restore_check(src_orders(t), tgt_orders(t), "id", ORDER_COLS)


USAGE = """(SELECT p_brand AS table_name, 'ix_' || l_partkey AS index_name, p_type || ',' || p_size AS index_columns, count(*) FILTER (WHERE l_quantity > 40) AS idx_scan,
  count(*) FILTER (WHERE l_returnflag = 'A') AS seeks, count(*) FILTER (WHERE l_returnflag = 'N') AS scans, count(*) FILTER (WHERE l_returnflag = 'R') AS lookups, count(*) FILTER (WHERE l_linestatus = 'F') AS updates
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def usage(t: Tables):
    per = t.lineitem.groupBy("l_partkey").agg(
        F.count_if(F.col("l_quantity") > 40).alias("idx_scan"),
        F.count_if(F.col("l_returnflag") == "A").alias("seeks"),
        F.count_if(F.col("l_returnflag") == "N").alias("scans"),
        F.count_if(F.col("l_returnflag") == "R").alias("lookups"),
        F.count_if(F.col("l_linestatus") == "F").alias("updates"),
    )
    joined = per.join(t.part, per.l_partkey == t.part.p_partkey)
    return joined.selectExpr(
        "p_brand AS table_name", "concat('ix_', l_partkey) AS index_name", "concat(p_type, ',', p_size) AS index_columns", "idx_scan", "seeks", "scans", "lookups", "updates"
    )


@query("q16_unused_indexes", f"SELECT table_name, index_name, idx_scan, CASE WHEN idx_scan = 0 THEN 'UNUSED' ELSE 'RARELY_USED' END AS finding FROM {USAGE} WHERE idx_scan < 5")
def unused(t: Tables):
    return q.unused_indexes(usage(t), 5).select("table_name", "index_name", "idx_scan", "finding")


@query(
    "q16_redundant_indexes",
    f"SELECT table_name, string_split(index_columns, ',')[1] AS leading_column, count(*) AS index_count, arg_max(index_name, (idx_scan, index_name)) AS keep_index FROM {USAGE} GROUP BY 1, 2 HAVING count(*) > 1",
)
def redundant(t: Tables):
    return q.redundant_indexes(usage(t))


@query("q16_seek_share", f"SELECT index_name, round(seeks * 100.0::double / nullif(seeks + scans + lookups + updates, 0), 1) AS seek_pct FROM {USAGE}")
def seeks(t: Tables):
    return q.seek_share(usage(t)).select("index_name", "seek_pct")


@query(
    "q17_access_audit",
    """SELECT c_custkey AS principal_id, n_name AS role_name, CASE WHEN d AND p THEN 'DISABLED_PRIVILEGED' WHEN p THEN 'PRIVILEGED' WHEN d THEN 'DISABLED' ELSE 'OK' END AS finding
     FROM (SELECT c_custkey, n_name, c_acctbal < 0 AS d, n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3)) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def grants(t: Tables):
    members = t.customer.selectExpr("c_custkey AS principal_id", "c_nationkey AS role_id")
    principals = t.customer.selectExpr("c_custkey AS principal_id", "c_acctbal < 0 AS is_disabled")
    # role names stand in for the privileged list; three of the 25 nations
    names = [r.n_name for r in t.nation.where("n_nationkey IN (1, 2, 3)").select("n_name").collect()]
    return q.access_audit(members, t.nation.selectExpr("n_nationkey AS role_id", "n_name AS role_name"), principals, names).select("principal_id", "role_name", "finding")


@query(
    "q18_config_drift",
    """WITH p AS (SELECT s_suppkey % 7 AS host, 'p' || s_suppkey AS name, cast(s_nationkey AS varchar) AS v FROM supplier WHERE s_suppkey % 19 <> 3),
      c AS (SELECT s_suppkey % 7 AS host, 'p' || s_suppkey AS name, CASE WHEN s_suppkey % 6 = 1 THEN 'x' ELSE cast(s_nationkey AS varchar) END AS v FROM supplier WHERE s_suppkey % 23 <> 3)
     SELECT coalesce(p.host, c.host) AS host, coalesce(p.name, c.name) AS name, coalesce(p.v, '') AS old_value, coalesce(c.v, '') AS new_value,
       CASE WHEN p.name IS NULL THEN 'ADDED' WHEN c.name IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM p FULL OUTER JOIN c ON p.host = c.host AND p.name = c.name WHERE p.v IS DISTINCT FROM c.v""",
)
def config(t: Tables):
    prev = t.supplier.where("s_suppkey % 19 <> 3").selectExpr("s_suppkey % 7 AS host", "concat('p', s_suppkey) AS name", "cast(s_nationkey AS string) AS v")
    cur = t.supplier.where("s_suppkey % 23 <> 3").selectExpr("s_suppkey % 7 AS host", "concat('p', s_suppkey) AS name", "CASE WHEN s_suppkey % 6 = 1 THEN 'x' ELSE cast(s_nationkey AS string) END AS v")
    out = q.config_drift(prev, cur, ["host", "name"], "v")
    return out.select("host", "name", F.coalesce("old_value", F.lit("")).alias("old_value"), F.coalesce("new_value", F.lit("")).alias("new_value"), "change")


@query(
    "q19_stale_stats",
    """WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 20 <> 0 THEN max(o_orderdate) END AS a, CASE WHEN count(*) % 5 = 0 THEN 'YES' ELSE 'NO' END AS f FROM orders GROUP BY o_custkey)
     SELECT o_custkey, CASE WHEN a IS NULL THEN 'NEVER_ANALYZED' WHEN f = 'YES' THEN 'FLAGGED' ELSE 'TOO_OLD' END AS reason FROM s, (SELECT max(o_orderdate) m FROM orders)
     WHERE a IS NULL OR f = 'YES' OR date_diff('day', cast(a AS date), cast(m AS date)) > 365""",
)
def stale(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "o_custkey", F.when(F.expr("o_custkey % 20 <> 0"), F.col("m")).alias("last_analyzed"), F.when(F.col("n") % 5 == 0, "YES").otherwise("NO").alias("stale_stats")
    )
    return q.stale_stats(per, "last_analyzed", 365, t.orders.agg(F.max("o_orderdate").alias("as_of"))).select("o_custkey", "reason")


# every role is a member of two others; cycles are among them
GRANTS_SQL = "(SELECT n_nationkey AS m, (n_nationkey * 2 + 1) % 25 AS r FROM nation UNION SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_nationkey % 2 = 0)"


@query(
    "q17_inherited_privileges",
    f"""WITH RECURSIVE g AS (SELECT m, r FROM {GRANTS_SQL}), way AS (
       SELECT m, r, 1 AS depth, [m, r] AS path FROM g
       UNION ALL SELECT way.m, g.r, depth + 1, list_append(path, g.r) FROM way JOIN g ON g.m = way.r WHERE depth < 26 AND NOT list_contains(path[2:], g.r)),
     best AS (SELECT m, r, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM way GROUP BY m, r),
     held AS (SELECT c_custkey AS p, c_nationkey AS r, 0 AS depth, [c_nationkey] AS path FROM customer UNION ALL SELECT c_custkey, best.r, depth, path FROM customer JOIN best ON c_nationkey = m),
     one AS (SELECT p, r, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM held GROUP BY p, r)
     SELECT p AS principal_id, n_name AS role_name, depth::INT AS depth, array_to_string(path, '>') AS path, CASE WHEN c_acctbal < 0 AND r IN (1, 2, 3) THEN 'DISABLED_PRIVILEGED' WHEN r IN (1, 2, 3) THEN 'PRIVILEGED' WHEN c_acctbal < 0 THEN 'DISABLED' ELSE 'OK' END AS finding
     FROM one JOIN nation ON n_nationkey = r JOIN customer ON c_custkey = p""",
)
def inherited(t: Tables):
    members = t.customer.selectExpr("c_custkey AS principal_id", "c_nationkey AS role_id")
    first = t.nation.selectExpr("n_nationkey AS member_role_id", "(n_nationkey * 2 + 1) % 25 AS role_id")
    grants = first.union(t.nation.where("n_nationkey % 2 = 0").selectExpr("n_nationkey", "(n_nationkey + 10) % 25"))
    principals = t.customer.selectExpr("c_custkey AS principal_id", "c_acctbal < 0 AS is_disabled")
    names = [r.n_name for r in t.nation.where("n_nationkey IN (1, 2, 3)").select("n_name").collect()]
    found = q.inherited_privileges(members, grants, t.nation.selectExpr("n_nationkey AS role_id", "n_name AS role_name"), principals, names)
    return found.select("principal_id", "role_name", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "finding")
