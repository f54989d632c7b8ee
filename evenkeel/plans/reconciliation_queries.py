"""Profiles, fingerprints, comparison, classes and repair of a drifted orders table."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.canon import raw_columns, canon_columns, digest_number, row_md5, row_text, wide_sum
from evenkeel.operators import compare as cmp, fingerprint as fp, gates, hash_tree, remediate as rem
from evenkeel.operators.reconcile import Scope, reconcile
from evenkeel.plans.derived import (
    sized,
    CANON_ORDER,
    KEY_HASH,
    ORDER_COLS,
    ORDER_HASH,
    SRC_ORDERS,
    TGT_ORDERS,
    TGT_ORDERS_DUP,
    changes,
    md5_number,
    src_orders,
    tgt_orders,
)
from evenkeel.plans.registry import Tables, query
from evenkeel.session import cut_lineage, scratch_path
from evenkeel.sources.writers import write_colocated

VALUES = [c for c in ORDER_COLS if c != "id"]
START, END = "TIMESTAMP '1997-01-01 00:00:00'", "TIMESTAMP '1998-01-01 00:00:00'"
START_SPARK, END_SPARK = "TIMESTAMP_NTZ '1997-01-01 00:00:00'", "TIMESTAMP_NTZ '1998-01-01 00:00:00'"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def id_and(text: str) -> str:
    return sized("cast(id AS varchar)") + " || '|' || " + sized(text)


@query("p05_canonical_rows", f"SELECT id, {CANON_ORDER} AS canon, md5({CANON_ORDER}) AS row_md5 FROM {TGT_ORDERS}")
def canonical_rows(t: Tables):
    d = tgt_orders(t)
    return d.select("id", row_text(d).alias("canon"), row_md5(d).alias("row_md5"))


PROFILE_SQL = "SELECT '{n}' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE {pk} IS NULL) AS null_pk_count, cast(min({pk}) AS varchar) AS min_pk, cast(max({pk}) AS varchar) AS max_pk FROM {src}"


@query(
    "a01_row_profile",
    " UNION ALL ".join(
        PROFILE_SQL.format(n=n, pk=pk, src=n) for n, pk in [("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey")]
    ),
)
def row_profiles(t: Tables):
    return union([
        fp.row_profile(t.orders, "orders", "o_orderkey"),
        fp.row_profile(t.customer, "customer", "c_custkey"),
        fp.row_profile(t.part, "part", "p_partkey"),
    ])


def bucket_sql(src: str, modulus: int = 256) -> str:
    return f"""SELECT 'orders' AS table_name, cast({KEY_HASH} % {modulus} AS int) AS bucket_id, count(*) AS row_count, bit_xor({ORDER_HASH}) AS bucket_checksum,
      cast(sum({ORDER_HASH}) AS varchar) AS hash_sum, cast(min(id) AS varchar) AS min_pk, cast(max(id) AS varchar) AS max_pk FROM {src} GROUP BY 2"""


@query("a02_bucket_hash", bucket_sql(SRC_ORDERS))
def bucket_hashes(t: Tables):
    return fp.bucket_hash(src_orders(t), "orders", "id", ORDER_COLS, 256)


# The aggregate rules of the two business tables, plus one unknown function and one broken predicate.
RULES = [
    fp.Rule("orders_total_amount", "total_amount", "SUM"),
    fp.Rule("orders_total_amount", "total_amount", "MIN"),
    fp.Rule("orders_total_amount", "total_amount", "MAX"),
    fp.Rule("orders_total_amount", "total_amount", "COUNT"),
    fp.Rule("open_orders", "total_amount", "SUM", "status = 'O'"),
    fp.Rule("open_orders", "total_amount", "MEDIAN", "status = 'O'"),
    fp.Rule("no_such_column", "missing_column", "SUM"),
]


def business_sql(src: str) -> str:
    v = "cast(total_amount AS decimal(38,6))"
    return f"""SELECT r.rule_name, r.agg_fn, r.agg_value FROM (
      SELECT cast(sum({v}) AS varchar) a, cast(min({v}) AS varchar) b, cast(max({v}) AS varchar) c, cast(count(*) AS varchar) d,
             cast(sum({v}) FILTER (WHERE status = 'O') AS varchar) e FROM {src}) s,
      LATERAL (VALUES ('orders_total_amount','SUM',s.a),('orders_total_amount','MIN',s.b),('orders_total_amount','MAX',s.c),
        ('orders_total_amount','COUNT',s.d),('open_orders','SUM',s.e),('open_orders','MEDIAN',NULL),('no_such_column','SUM',NULL)) r(rule_name, agg_fn, agg_value)"""


@query("a03_business_profile", business_sql(SRC_ORDERS))
def business_profiles(t: Tables):
    return fp.business_profile(src_orders(t), RULES)


def summary_sql(src: str) -> str:
    return f"""SELECT 'sales' AS schema_name, 'orders' AS table_name, count(*) AS row_count, cast(sum({ORDER_HASH}) AS varchar) AS hash_sum,
      count(*) FILTER (WHERE updated_at >= {START} AND updated_at < {END}) AS updated_count, count(*) FILTER (WHERE is_deleted) AS deleted_count FROM {src}"""


def summary_of(d: DataFrame) -> DataFrame:
    return fp.table_summary(d, "sales", "orders", ORDER_COLS, "updated_at", F.col("is_deleted"), F.expr(START_SPARK), F.expr(END_SPARK))


@query("a04_table_summary", summary_sql(SRC_ORDERS))
def table_summaries(t: Tables):
    return summary_of(src_orders(t))


def _levels(src: str) -> str:
    ctes = [f"""r AS (SELECT id, count(*) n, concat_ws('*', count(*), min(md5({CANON_ORDER})), max(md5({CANON_ORDER})), sum({ORDER_HASH})) d FROM {src} GROUP BY 1),
      l0 AS (SELECT id // 1000 b, sum(n) row_count, sha256(string_agg(d, '||' ORDER BY id)) d FROM r GROUP BY 1)"""]
    for i in range(6):
        ctes.append(f"l{i+1} AS (SELECT b // 1000 b, sum(row_count) row_count, sha256(string_agg(d, '||' ORDER BY b)) d FROM l{i} GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT cast(sum(row_count) AS bigint) AS row_count, sha256(string_agg(d, '||' ORDER BY b)) AS checksum FROM l6"


@query("a05_ordered_checksum", _levels(TGT_ORDERS_DUP))
def ordered(t: Tables):
    return fp.ordered_checksum(tgt_orders(t, duplicates=True), "id", ORDER_COLS)


CANON_COMMA = CANON_ORDER.replace("concat_ws('|'", "concat_ws(','")


@query("a06_row_digests", f"SELECT id AS pk, sha256({CANON_COMMA}) AS row_sha256 FROM {SRC_ORDERS}")
def digests(t: Tables):
    return fp.row_digests(src_orders(t), "id", ORDER_COLS)


@query("a06_row_digest_sample", f"SELECT id AS pk, sha256({CANON_COMMA}) AS row_sha256 FROM {SRC_ORDERS} ORDER BY 1, 2 LIMIT 1000")
def digest_sample(t: Tables):
    return fp.row_digests(src_orders(t), "id", ORDER_COLS, 1000)


@query(
    "a07_key_coverage",
    f"SELECT min(id) AS min_pk, max(id) AS max_pk, count(*) AS rows_in_window FROM {SRC_ORDERS} WHERE updated_at >= {START} AND updated_at < {END}",
)
def coverage(t: Tables):
    return fp.key_coverage(src_orders(t), "id", "updated_at", F.expr(START_SPARK), F.expr(END_SPARK))


@query(
    "a08_null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {TGT_ORDERS}" for c in ORDER_COLS),
)
def nulls(t: Tables):
    return fp.null_counts(tgt_orders(t))


@query(
    "a09_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(t: Tables):
    return fp.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "a10_distinct_keys",
    """SELECT 'source' AS side, count(*) AS row_count, count(DISTINCT id) AS distinct_keys FROM %s
       UNION ALL SELECT 'target', count(*), count(DISTINCT id) FROM %s""" % (SRC_ORDERS, TGT_ORDERS_DUP),
)
def distincts(t: Tables):
    return fp.distinct_keys(src_orders(t), ["id"]).withColumn("side", F.lit("source")).unionByName(
        fp.distinct_keys(tgt_orders(t, True), ["id"]).withColumn("side", F.lit("target"))
    )


def both_summaries(orders: str) -> str:
    """Orders of one side, and customers, which are the same on both sides."""
    customer = "(SELECT c_custkey AS id, c_name AS status, cast(c_acctbal AS decimal(18,2)) AS total_amount, TIMESTAMP '1997-06-01' AS updated_at, c_acctbal < 0 AS is_deleted FROM customer)"
    return summary_sql(orders) + " UNION ALL " + summary_sql(customer).replace("'orders' AS table_name", "'customer' AS table_name")


SUMMARY_COMPARE = f"""
WITH s AS ({both_summaries(SRC_ORDERS)}), t AS ({both_summaries(TGT_ORDERS_DUP)}),
c AS (SELECT s.schema_name, s.table_name, s.row_count = t.row_count AS count_match, s.hash_sum = t.hash_sum AS hash_match,
  s.updated_count = t.updated_count AS update_match, s.deleted_count = t.deleted_count AS delete_match,
  t.row_count - s.row_count AS rd, t.updated_count - s.updated_count AS ud, t.deleted_count - s.deleted_count AS dd FROM s JOIN t USING (schema_name, table_name)),
r AS (SELECT schema_name, table_name, count_match, hash_match, update_match, delete_match,
  '{{' || concat_ws(',', CASE WHEN rd <> 0 THEN '"row_count_delta":' || rd END, CASE WHEN ud <> 0 THEN '"update_delta":' || ud END, CASE WHEN dd <> 0 THEN '"delete_delta":' || dd END) || '}}' AS deltas,
  CASE WHEN NOT count_match AND NOT hash_match THEN 'SEV1' WHEN NOT (count_match AND hash_match AND update_match AND delete_match) THEN 'SEV2' ELSE 'OK' END AS severity FROM c)
"""


def compared_summaries(t: Tables) -> DataFrame:
    customer = t.customer.selectExpr(
        "c_custkey AS id", "c_name AS status", "cast(c_acctbal AS decimal(18,2)) AS total_amount", "TIMESTAMP_NTZ '1997-06-01 00:00:00' AS updated_at", "c_acctbal < 0 AS is_deleted"
    )
    same = summary_of(customer).withColumn("table_name", F.lit("customer"))
    return cmp.compare_summaries(summary_of(src_orders(t)).unionByName(same), summary_of(tgt_orders(t, True)).unionByName(same))


@query("j04_compare_summaries", SUMMARY_COMPARE + "SELECT * FROM r")
def summaries_compared(t: Tables):
    return compared_summaries(t)


@query(
    "q01_gap_class",
    SUMMARY_COMPARE
    + """SELECT schema_name, table_name, gap_class, CASE gap_class WHEN 'CLASS-A' THEN 'Re-extract and replay missing/extra key ranges; then hash validate'
  WHEN 'CLASS-B' THEN 'Run row-level diff and targeted UPDATE remediation' WHEN 'CLASS-C' THEN 'Replay CDC from safe checkpoint and validate operation parity'
  ELSE 'No remediation required' END AS recommended_action FROM (SELECT *, CASE WHEN NOT count_match AND NOT hash_match THEN 'CLASS-A' WHEN count_match AND NOT hash_match THEN 'CLASS-B'
  WHEN NOT update_match OR NOT delete_match THEN 'CLASS-C' ELSE 'OK' END AS gap_class FROM r)""",
)
def gap_classes(t: Tables):
    return gates.classify_gaps(compared_summaries(t)).select("schema_name", "table_name", "gap_class", "recommended_action")


@query(
    "j01_compare_row_profiles",
    f"""WITH s AS ({PROFILE_SQL.format(n='orders', pk='id', src=SRC_ORDERS)} UNION ALL {PROFILE_SQL.format(n='customer', pk='c_custkey', src='customer')}
       UNION ALL {PROFILE_SQL.format(n='part', pk='p_partkey', src='part')}),
     t AS ({PROFILE_SQL.format(n='orders', pk='id', src=TGT_ORDERS)} UNION ALL {PROFILE_SQL.format(n='customer', pk='c_custkey', src='customer')}
       UNION ALL {PROFILE_SQL.format(n='supplier', pk='s_suppkey', src='supplier')})
     SELECT coalesce(t.table_name, s.table_name) AS table_name, coalesce(s.row_count,-1) AS source_row_count, coalesce(t.row_count,-1) AS target_row_count,
       coalesce(t.row_count,0) - coalesce(s.row_count,0) AS row_count_diff, coalesce(s.null_pk_count,-1) AS source_null_pk, coalesce(t.null_pk_count,-1) AS target_null_pk,
       CASE WHEN s.table_name IS NULL OR t.table_name IS NULL THEN 'FAIL_MISSING_TABLE' WHEN coalesce(t.row_count,-1) <> coalesce(s.row_count,-1) THEN 'FAIL_ROW_COUNT'
            WHEN coalesce(t.null_pk_count,-1) <> coalesce(s.null_pk_count,-1) THEN 'FAIL_NULL_PK' ELSE 'PASS' END AS status
     FROM t FULL OUTER JOIN s ON s.table_name = t.table_name""",
)
def profiles_compared(t: Tables):
    src = union([fp.row_profile(src_orders(t), "orders", "id"), fp.row_profile(t.customer, "customer", "c_custkey"), fp.row_profile(t.part, "part", "p_partkey")])
    tgt = union([fp.row_profile(tgt_orders(t), "orders", "id"), fp.row_profile(t.customer, "customer", "c_custkey"), fp.row_profile(t.supplier, "supplier", "s_suppkey")])
    sides = ["source_row_count", "target_row_count", "source_null_pk", "target_null_pk"]
    return cmp.compare_row_profiles(src, tgt).fillna(-1, sides)


J02_SQL = f"""WITH s AS ({bucket_sql(SRC_ORDERS)}), t AS ({bucket_sql(TGT_ORDERS)})
     SELECT coalesce(t.table_name, s.table_name) AS table_name, coalesce(t.bucket_id, s.bucket_id) AS bucket_id, s.row_count AS source_row_count, t.row_count AS target_row_count,
       CASE WHEN s.table_name IS NULL OR t.table_name IS NULL THEN 'FAIL_MISSING_BUCKET' WHEN s.row_count <> t.row_count THEN 'FAIL_BUCKET_ROW_COUNT'
            WHEN s.bucket_checksum <> t.bucket_checksum OR s.hash_sum <> t.hash_sum THEN 'FAIL_BUCKET_HASH' ELSE 'PASS' END AS status
     FROM t FULL OUTER JOIN s ON s.table_name = t.table_name AND s.bucket_id = t.bucket_id"""


@query("j02_compare_buckets", J02_SQL)
def buckets_compared(t: Tables):
    return cmp.compare_buckets(
        fp.bucket_hash(src_orders(t), "orders", "id", ORDER_COLS, 256), fp.bucket_hash(tgt_orders(t), "orders", "id", ORDER_COLS, 256)
    )


@query("s09_colocated_compare", J02_SQL)
def colocated_compared(t: Tables):
    names, sides = [f"colocated_{uuid4().hex}" for _ in range(2)], []
    for name, rows in zip(names, (src_orders(t), tgt_orders(t))):
        sides.append(write_colocated(rows, name, "id", scratch_path(t.spark, name), 256, 16))
    done = cut_lineage(cmp.compare_colocated(*sides, "id", "orders", ORDER_COLS))
    for name in names:
        t.spark.sql(f"DROP TABLE {name}")
    return done


@query(
    "j03_compare_business",
    f"""WITH s AS ({business_sql(SRC_ORDERS)}), t AS ({business_sql(TGT_ORDERS)})
     SELECT s.rule_name, s.agg_fn, coalesce(s.agg_value,'<null>') AS source_value, coalesce(t.agg_value,'<null>') AS target_value,
       CASE WHEN coalesce(s.agg_value,'<null>') <> coalesce(t.agg_value,'<null>') THEN 'FAIL_AGG_MISMATCH' ELSE 'PASS' END AS status
     FROM s JOIN t USING (rule_name, agg_fn)""",
)
def business_compared(t: Tables):
    return cmp.compare_business(fp.business_profile(src_orders(t), RULES), fp.business_profile(tgt_orders(t), RULES))


# the key scope: every key of a 500-key range whose fingerprint differs
LOCAL = """WITH s AS (SELECT id // 500 AS slice, count(*) AS n, sum({h}) AS h FROM {a} GROUP BY 1), t AS (SELECT id // 500 AS slice, count(*) AS n, sum({h}) AS h FROM {b} GROUP BY 1)
  SELECT coalesce(s.slice, t.slice) AS slice FROM s FULL OUTER JOIN t ON s.slice = t.slice WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""".format(h=ORDER_HASH, a=SRC_ORDERS, b=TGT_ORDERS)
GAPS = f"(SELECT id AS key_id FROM (SELECT id FROM {SRC_ORDERS} UNION SELECT id FROM {TGT_ORDERS}) WHERE id // 500 IN ({LOCAL}))"


def gap_scope(t: Tables) -> DataFrame:
    s, g = src_orders(t), tgt_orders(t)
    slices = cmp.localise(s, g, lambda d: F.expr("id div 500"), ORDER_COLS).select("slice")
    keys = s.select("id").unionByName(g.select("id")).withColumn("slice", F.expr("id div 500"))
    return keys.join(slices, "slice", "left_semi").select(F.col("id").alias("key_id"))


@query(
    "j05_missing_rows",
    f"SELECT s.id, s.status, cast(s.total_amount AS double) AS total_amount FROM {SRC_ORDERS} s LEFT JOIN {TGT_ORDERS} t ON t.id = s.id WHERE t.id IS NULL AND s.id IN (SELECT key_id FROM {GAPS})",
)
def missing(t: Tables):
    return cmp.missing_rows(src_orders(t), tgt_orders(t), "id", gap_scope(t)).select("id", "status", F.col("total_amount").cast("double").alias("total_amount"))


@query(
    "j06_extra_rows",
    f"SELECT t.id, t.status FROM {TGT_ORDERS} t WHERE NOT EXISTS (SELECT 1 FROM {SRC_ORDERS} s WHERE s.id = t.id) AND t.id IN (SELECT key_id FROM {GAPS})",
)
def extra(t: Tables):
    return cmp.extra_rows(src_orders(t), tgt_orders(t), "id", gap_scope(t)).select("id", "status")


@query("j07_in_scope", f"SELECT id, status FROM {TGT_ORDERS} WHERE id IN (SELECT key_id FROM {GAPS})")
def scoped(t: Tables):
    return cmp.in_scope(tgt_orders(t), gap_scope(t), "id").select("id", "status")


ROW_DIFF = f"""SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  CASE WHEN s.id IS NULL OR t.id IS NULL THEN '' ELSE concat_ws(',', {', '.join(f"CASE WHEN s.{c} IS DISTINCT FROM t.{c} THEN '{c}' END" for c in VALUES)}) END AS columns
  FROM {SRC_ORDERS} s FULL OUTER JOIN {TGT_ORDERS} t ON s.id = t.id
  WHERE s.id IS NULL OR t.id IS NULL OR {' OR '.join(f's.{c} IS DISTINCT FROM t.{c}' for c in VALUES)}"""


@query("j08_row_diff", ROW_DIFF)
def diffs(t: Tables):
    return cmp.row_diff(src_orders(t), tgt_orders(t), ["id"], VALUES)


OC = "id, status, total_amount, updated_at, is_deleted"


@query(
    "u03_result_diff",
    f"""SELECT id, status, side, copies FROM (
     SELECT {OC}, 'SOURCE' AS side, count(*) AS copies FROM (SELECT {OC} FROM {SRC_ORDERS} EXCEPT ALL SELECT {OC} FROM {TGT_ORDERS_DUP}) GROUP BY ALL
     UNION ALL
     SELECT {OC}, 'TARGET' AS side, count(*) AS copies FROM (SELECT {OC} FROM {TGT_ORDERS_DUP} EXCEPT ALL SELECT {OC} FROM {SRC_ORDERS}) GROUP BY ALL)""",
)
def result_diffs(t: Tables):
    return cmp.result_diff(src_orders(t), tgt_orders(t, True)).select("id", "status", "side", "copies")


@query("t05_sample_rows", f"SELECT id, status FROM {TGT_ORDERS} WHERE {KEY_HASH} % 100 < 10")
def sampled(t: Tables):
    return fp.sample_rows(tgt_orders(t), "id", 10).select("id", "status")


def match_sql(where: str) -> str:
    return f"""SELECT count(*) AS rows_compared, count(t.id) AS rows_matched, round(100.0::double * count(t.id) / count(*), 4) AS match_pct,
  CASE WHEN round(100.0::double * count(t.id) / count(*), 4) >= 99.9 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT id, md5({CANON_ORDER}) d FROM {SRC_ORDERS} WHERE {where}) s LEFT JOIN (SELECT DISTINCT id, md5({CANON_ORDER}) d FROM {TGT_ORDERS}) t ON s.id = t.id AND s.d = t.d"""


@query("t06_match_rate", match_sql("true"))
def match_all(t: Tables):
    return cmp.match_rate(src_orders(t), tgt_orders(t), "id", ORDER_COLS)


@query("t06_match_rate_sampled", match_sql(f"{KEY_HASH} % 100 < 10"))
def match_sampled(t: Tables):
    return cmp.match_rate(src_orders(t), tgt_orders(t), "id", ORDER_COLS, pct=10)


GROUPED = """SELECT status, year(updated_at) AS order_year, grouping(status, year(updated_at)) AS grouping_level,
  count(*) FILTER (WHERE side = 's') AS source_rows, count(*) FILTER (WHERE side = 't') AS target_rows,
  cast(sum(total_amount) FILTER (WHERE side = 's') AS varchar) AS source_amount, cast(sum(total_amount) FILTER (WHERE side = 't') AS varchar) AS target_amount
  FROM (SELECT *, 's' AS side FROM %s UNION ALL SELECT *, 't' AS side FROM %s) GROUP BY GROUPING SETS ((status), (year(updated_at)), ())
""" % (SRC_ORDERS, TGT_ORDERS)


@query(
    "a38_breakdown",
    f"SELECT coalesce(status,'(null)') AS status, cast(coalesce(order_year,0) AS int) AS order_year, grouping_level, source_rows, target_rows, coalesce(source_amount,'') AS source_amount, target_amount FROM ({GROUPED}) WHERE source_rows IS DISTINCT FROM target_rows OR source_amount IS DISTINCT FROM target_amount",
)
def broken_down(t: Tables):
    s, g = src_orders(t), tgt_orders(t)
    year = F.year("updated_at")
    out = cmp.breakdown(s.withColumn("order_year", year), g.withColumn("order_year", year), ["status", "order_year"], "total_amount")
    return out.select(
        F.coalesce("status", F.lit("(null)")).alias("status"),
        F.coalesce("order_year", F.lit(0)).alias("order_year"),
        "grouping_level",
        "source_rows",
        "target_rows",
        F.coalesce("source_amount", F.lit("")).alias("source_amount"),
        "target_amount",
    )


OPS = "(SELECT ts, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, event_id FROM events)"


@query(
    "a39_op_parity",
    f"""WITH s AS (SELECT date_trunc('day', ts) AS w, op, count(*) n FROM {OPS} GROUP BY 1,2),
     t AS (SELECT date_trunc('day', ts) AS w, op, count(*) n FROM {OPS} WHERE event_id % 100 <> 0 GROUP BY 1,2)
     SELECT coalesce(s.w,t.w)::timestamp AS window_start, coalesce(s.op,t.op) AS op, coalesce(s.n,0) AS source_ops, coalesce(t.n,0) AS target_ops, coalesce(t.n,0) - coalesce(s.n,0) AS delta
     FROM s FULL OUTER JOIN t ON s.w = t.w AND s.op = t.op""",
)
def parity(t: Tables):
    c = changes(t)
    return cmp.op_parity(c, c.where("seq % 100 <> 0"), "ts", "op", "day")


def slice_sql(src: str, by: str, hash_: str = ORDER_HASH) -> str:
    return f"SELECT {by} AS slice, count(*) AS n, sum({hash_}) AS h FROM {src} GROUP BY 1"


@query(
    "q03_localise_key_range",
    f"""WITH s AS ({slice_sql(SRC_ORDERS, 'id // 500')}), t AS ({slice_sql(TGT_ORDERS, 'id // 500')})
     SELECT coalesce(s.slice,t.slice) AS slice, CASE WHEN s.n IS DISTINCT FROM t.n THEN 'COUNT' ELSE 'HASH' END AS difference, coalesce(s.n,0) AS source_rows, coalesce(t.n,0) AS target_rows
     FROM s FULL OUTER JOIN t ON s.slice = t.slice WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""",
)
def localised(t: Tables):
    return cmp.localise(src_orders(t), tgt_orders(t), lambda d: F.expr("id div 500"), ORDER_COLS)


@query(
    "q03_localise_time_window",
    f"""WITH s AS ({slice_sql(SRC_ORDERS, "strftime(updated_at,'%Y-%m')")}), t AS ({slice_sql(TGT_ORDERS, "strftime(updated_at,'%Y-%m')")})
     SELECT coalesce(s.slice,t.slice) AS slice, CASE WHEN s.n IS DISTINCT FROM t.n THEN 'COUNT' ELSE 'HASH' END AS difference, coalesce(s.n,0) AS source_rows, coalesce(t.n,0) AS target_rows
     FROM s FULL OUTER JOIN t ON s.slice = t.slice WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""",
)
def localised_time(t: Tables):
    return cmp.localise(src_orders(t), tgt_orders(t), lambda d: F.date_format("updated_at", "yyyy-MM"), ORDER_COLS)


@query(
    "q03_hash_tree",
    f"""WITH s AS ({slice_sql(SRC_ORDERS, 'id // 512')}), t AS ({slice_sql(TGT_ORDERS, 'id // 512')})
     SELECT coalesce(s.slice,t.slice) * 512 AS low, coalesce(s.slice,t.slice) * 512 + 511 AS high, CASE WHEN s.n IS DISTINCT FROM t.n THEN 'COUNT' ELSE 'HASH' END AS difference,
       coalesce(s.n,0) AS source_rows, coalesce(t.n,0) AS target_rows
     FROM s FULL OUTER JOIN t ON s.slice = t.slice WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""",
)
def hash_tree_gap(t: Tables):
    shape, paths = hash_tree.Shape(512, 8, 4), [scratch_path(t.spark, "tree") for _ in range(2)]
    for path, rows in zip(paths, (src_orders(t), tgt_orders(t))):
        hash_tree.build_tree(rows, "id", path, ORDER_COLS, shape)
    return hash_tree.descend(t.spark, *paths, shape).ranges


E01_SQL = f"""WITH s AS ({bucket_sql(SRC_ORDERS)}), t AS ({bucket_sql(TGT_ORDERS)}),
  o AS (SELECT 'orders' AS table_name, 'critical' AS scope, sum(coalesce(s.row_count, 0)) AS source_rows, sum(coalesce(t.row_count, 0)) AS target_rows, count(*) AS buckets,
      count(*) FILTER (WHERE s.row_count IS DISTINCT FROM t.row_count OR s.hash_sum IS DISTINCT FROM t.hash_sum OR s.bucket_checksum IS DISTINCT FROM t.bucket_checksum) AS bad_buckets
    FROM s FULL OUTER JOIN t ON s.bucket_id = t.bucket_id),
  c AS (SELECT 'customer', 'non_critical', count(*), count(*), count(DISTINCT {md5_number(sized("cast(c_custkey AS varchar)"))} % 64), 0 FROM customer),
  r AS (SELECT * FROM o UNION ALL SELECT * FROM c),
  p AS (SELECT *, CASE WHEN source_rows = target_rows THEN 0.0 WHEN source_rows = 0 THEN 100.0 ELSE round(100.0::double * abs(target_rows - source_rows)::double / source_rows::double, 6) END::double AS diff_pct,
      CASE scope WHEN 'critical' THEN 0.0 ELSE 0.01 END::double AS tolerance_pct FROM r)
SELECT table_name, scope, source_rows::bigint AS source_rows, target_rows::bigint AS target_rows, buckets, bad_buckets,
  CASE WHEN source_rows <> target_rows AND bad_buckets > 0 THEN 'CLASS-A' WHEN bad_buckets > 0 THEN 'CLASS-B' ELSE 'OK' END AS gap_class, diff_pct, tolerance_pct,
  CASE WHEN bad_buckets = 0 THEN 'PASS' WHEN diff_pct <= tolerance_pct AND source_rows <> target_rows THEN 'PASS_WITH_TOLERANCE' ELSE 'FAIL' END AS status FROM p"""


@query("e01_reconcile", E01_SQL)
def whole_run(t: Tables):
    scopes = [Scope("orders", "id", ORDER_COLS, 256), Scope("customer", "c_custkey", None, 64, critical=False)]
    report = reconcile(scopes, {"orders": src_orders(t), "customer": t.customer}.get, {"orders": tgt_orders(t), "customer": t.customer}.get)
    return report.drop("recommended_action", "missing", "extra", "changed", "update_match", "delete_match", "bad_rules")


@query(
    "e01_reconcile_tolerance",
    f"""WITH d AS (SELECT count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'extra') AS extra, count(*) FILTER (WHERE kind = 'changed') AS changed FROM ({ROW_DIFF})),
  n AS (SELECT count(*) AS source_rows FROM {SRC_ORDERS})
  SELECT 'orders' AS table_name, source_rows, missing, extra, changed, CASE WHEN missing + extra + changed = 0 THEN 'PASS' WHEN 100.0::double * (missing + extra + changed) <= 0.01::double * source_rows THEN 'PASS_WITH_TOLERANCE' ELSE 'FAIL' END AS status FROM d, n""",
)
def tolerant_run(t: Tables):
    report = reconcile([Scope("orders", "id", ORDER_COLS, 256, critical=False)], {"orders": src_orders(t)}.get, {"orders": tgt_orders(t)}.get)
    return report.select("table_name", "source_rows", "missing", "extra", "changed", "status")


# one run over five tables: within tolerance, beyond it, equal, with a rule that fails, with other deletes only
RUN_SRC = ["event_id AS id", "event_type AS kind", "CAST(value AS DECIMAL(18,2)) AS amount", "event_type = 'error' AS gone"]
RUN_HASH = md5_number(f"concat_ws('|', {sized('cast(id AS varchar)')}, {sized('trim(kind)')}, {sized('cast(amount AS varchar)')})")
RUN_BUCKET = md5_number(sized("cast(id AS varchar)")) + " % 128"
RUN_COLS = ["id", "kind", "amount"]
RUN_TOLERANCES = {"critical": 0.0, "non_critical": 1.0}
RUN = {"few": ("non_critical", "drifted"), "strict": ("critical", "drifted"), "same": ("non_critical", "src"), "rule": ("non_critical", "drifted"), "deletes": ("non_critical", "flagged")}


def run_sql(name: str, scope: str, target: str) -> str:
    return f"""SELECT '{name}' AS table_name, '{scope}' AS scope, (SELECT count(*) FROM src) AS source_rows, (SELECT count(*) FROM {target}) AS target_rows, buckets, bad_buckets, missing, extra, changed,
      true AS update_match, {f"(SELECT count(*) FILTER (WHERE gone) FROM src) = (SELECT count(*) FILTER (WHERE gone) FROM {target})" if name == "deletes" else "true"} AS delete_match,
      {f"CASE WHEN (SELECT sum(amount) FROM src) <> (SELECT sum(amount) FROM {target}) THEN 1 ELSE 0 END" if name == "rule" else "0"}::bigint AS bad_rules
    FROM (SELECT count(*) AS buckets, count(*) FILTER (WHERE x.n IS DISTINCT FROM y.n OR x.h IS DISTINCT FROM y.h) AS bad_buckets
        FROM (SELECT {RUN_BUCKET} AS b, count(*) AS n, sum({RUN_HASH}) AS h FROM src GROUP BY 1) x FULL OUTER JOIN (SELECT {RUN_BUCKET} AS b, count(*) AS n, sum({RUN_HASH}) AS h FROM {target} GROUP BY 1) y ON x.b = y.b),
      (SELECT count(*) FILTER (WHERE y.id IS NULL) AS missing, count(*) FILTER (WHERE x.id IS NULL) AS extra, count(*) FILTER (WHERE x.kind <> y.kind OR x.amount <> y.amount) AS changed
        FROM src x FULL OUTER JOIN {target} y ON x.id = y.id)"""


@query(
    "e01_reconcile_report",
    f"""WITH src AS (SELECT {', '.join(RUN_SRC)} FROM events),
  drifted AS (SELECT id, CASE WHEN id % 500 = 7 THEN 'other' ELSE kind END AS kind, amount, gone FROM src WHERE id % 500 <> 3
    UNION ALL SELECT id + 1000000000, kind, amount, gone FROM src WHERE id % 500 = 9),
  flagged AS (SELECT id, kind, amount, gone OR id % 100 = 1 AS gone FROM src),
  r AS ({' UNION ALL '.join(run_sql(n, *x) for n, x in RUN.items())}),
  g AS (SELECT *, CASE WHEN source_rows <> target_rows AND bad_buckets > 0 THEN 'CLASS-A' WHEN bad_buckets > 0 THEN 'CLASS-B' WHEN NOT update_match OR NOT delete_match THEN 'CLASS-C' ELSE 'OK' END AS gap_class,
    round(100.0::double * abs(target_rows - source_rows)::double / source_rows::double, 6) AS diff_pct, CASE scope WHEN 'critical' THEN 0.0 ELSE 1.0 END::double AS tolerance_pct FROM r)
  SELECT *, CASE WHEN bad_rules > 0 OR gap_class = 'CLASS-C' THEN 'FAIL' WHEN bad_buckets = 0 THEN 'PASS'
    WHEN 100.0::double * (missing + extra + changed) <= tolerance_pct * source_rows THEN 'PASS_WITH_TOLERANCE' ELSE 'FAIL' END AS status FROM g""",
)
def run_report(t: Tables):
    src = t.events.selectExpr(*RUN_SRC)
    copies = F.array_compact(F.array(F.when(F.expr("id % 500 <> 3"), F.col("id")), F.when(F.expr("id % 500 = 9"), F.col("id") + 1000000000)))
    other = F.expr("CASE WHEN id % 500 = 7 AND copy < 1000000000 THEN 'other' ELSE kind END")
    drifted = src.withColumn("copy", F.explode(copies)).select(F.col("copy").alias("id"), other.alias("kind"), "amount", "gone")
    targets = {"src": src, "drifted": drifted, "flagged": src.withColumn("gone", F.expr("gone OR id % 100 = 1"))}
    more = {"rule": {"rules": [fp.Rule("total", "amount", "SUM")]}, "deletes": {"deleted": "gone"}}
    scopes = [Scope(n, "id", RUN_COLS, 128, critical=scope == "critical", **more.get(n, {})) for n, (scope, _) in RUN.items()]
    return reconcile(scopes, lambda n: src, lambda n: targets[RUN[n][1]], RUN_TOLERANCES).drop("recommended_action")


@query("q04_gap_keys", f"SELECT id AS key_id, CASE kind WHEN 'missing' THEN 'INSERT' WHEN 'extra' THEN 'DELETE' ELSE 'UPDATE' END AS repair FROM ({ROW_DIFF})")
def keys_to_repair(t: Tables):
    return rem.gap_keys(src_orders(t), tgt_orders(t), "id", VALUES)


@query(
    "q04_remediate",
    f"""WITH k AS (SELECT id FROM ({ROW_DIFF}))
     SELECT id, status, cast(total_amount AS double) AS total_amount, is_deleted FROM {TGT_ORDERS} WHERE id NOT IN (SELECT id FROM k)
     UNION ALL SELECT id, status, cast(total_amount AS double), is_deleted FROM {SRC_ORDERS} WHERE id IN (SELECT id FROM k)""",
)
def remediated(t: Tables):
    s, g = src_orders(t), tgt_orders(t)
    # the key list is small and used twice: kept, so the tables are compared once
    keys = cut_lineage(rem.gap_keys(s, g, "id", VALUES))
    return rem.remediate(g, s, keys, "id").select("id", "status", F.col("total_amount").cast("double").alias("total_amount"), "is_deleted")


@query("q04_post_check", f"SELECT 0 AS still_different, (SELECT count(*) FROM {SRC_ORDERS}) AS source_rows, (SELECT count(*) FROM {SRC_ORDERS}) AS target_rows")
def checked_repair(t: Tables):
    """The repaired target has the source's rows and no others."""
    s, g = src_orders(t), tgt_orders(t)
    fixed = cut_lineage(rem.remediate(g, s, cut_lineage(rem.gap_keys(s, g, "id", VALUES)), "id"))
    left = cmp.row_diff(s, fixed, ["id"], VALUES).agg(F.count(F.lit(1)).alias("still_different"))
    one = F.lit(1)
    return left.select("still_different", s.agg(F.count(one)).scalar().alias("source_rows"), fixed.agg(F.count(one)).scalar().alias("target_rows"))


@query(
    "q05_adjacent_check",
    f"""WITH b AS ({slice_sql(TGT_ORDERS, 'id // 500')}), m AS (SELECT DISTINCT s.id // 500 AS x FROM {SRC_ORDERS} s WHERE NOT EXISTS (SELECT 1 FROM {TGT_ORDERS} t WHERE t.id = s.id)),
     near AS (SELECT DISTINCT x FROM (SELECT unnest([x - 1, x + 1]) AS x FROM m) WHERE x NOT IN (SELECT x FROM m))
     SELECT slice, 'UNCHANGED' AS status FROM b JOIN near ON b.slice = near.x""",
)
def adjacent(t: Tables):
    s, g = src_orders(t), tgt_orders(t)
    by = lambda d: F.expr("id div 500")
    repaired = cut_lineage(cmp.missing_rows(s, g, "id").select(F.expr("id div 500").alias("slice")).distinct())
    keys = s.withColumn("slice", by(s)).join(repaired, "slice", "left_semi").select(F.col("id").alias("key_id"))
    return cmp.adjacent_check(g, rem.remediate(g, s, keys, "id"), repaired, ORDER_COLS, by)


@query(
    "q06_tolerance_gate",
    f"""WITH s AS (SELECT coalesce(status,'?') AS status, sum(total_amount) v FROM {SRC_ORDERS} GROUP BY 1), t AS (SELECT coalesce(status,'?') AS status, sum(total_amount) v FROM {TGT_ORDERS} GROUP BY 1),
     c AS (SELECT coalesce(s.status,t.status) AS status, CASE coalesce(s.status,t.status) WHEN 'F' THEN 'critical' WHEN 'O' THEN 'non_critical' ELSE 'financial' END AS scope, coalesce(s.v,0) sv, coalesce(t.v,0) tv FROM s FULL OUTER JOIN t ON s.status = t.status),
     d AS (SELECT *, CASE WHEN tv = sv THEN 0.0 WHEN sv = 0 THEN 100.0 ELSE round(100.0::double * cast(abs(tv - sv) AS double) / cast(abs(sv) AS double), 6) END::double AS diff_pct, CASE scope WHEN 'non_critical' THEN 0.01 ELSE 0.0 END::double AS tolerance_pct FROM c)
     SELECT status AS order_status, scope, diff_pct, tolerance_pct, CASE WHEN diff_pct <= tolerance_pct THEN 'PASS' ELSE 'FAIL' END AS status FROM d""",
)
def gated(t: Tables):
    def by_status(d, name):
        return d.groupBy(F.coalesce("status", F.lit("?")).alias("order_status")).agg(F.sum("total_amount").alias(name))

    zero = F.lit(0).cast("decimal(28,2)")
    both = by_status(src_orders(t), "source_value").join(by_status(tgt_orders(t), "target_value"), "order_status", "full_outer").select(
        "order_status", F.coalesce("source_value", zero).alias("source_value"), F.coalesce("target_value", zero).alias("target_value")
    )
    scope = F.when(F.col("order_status") == "F", "critical").when(F.col("order_status") == "O", "non_critical").otherwise("financial")
    # Percent allowed per scope.
    tolerances = {"critical": 0.0, "non_critical": 0.01, "financial": 0.0}
    return gates.tolerance_gate(both.withColumn("scope", scope), tolerances).select("order_status", "scope", "diff_pct", "tolerance_pct", "status")


@query(
    "q07_cutover_readiness",
    f"""WITH c AS (SELECT 'ORPHANS' AS check_name, count(*) AS violations FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
       UNION ALL SELECT 'NULL_STATUS', count(*) FROM {TGT_ORDERS} WHERE status IS NULL
       UNION ALL SELECT 'MISSING_ROWS', count(*) FROM {SRC_ORDERS} s WHERE NOT EXISTS (SELECT 1 FROM {TGT_ORDERS} t WHERE t.id = s.id))
     SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
)
def readiness(t: Tables):
    def check(name, df):
        return df.agg(F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit(name))

    orphans = t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey, "left_anti")
    return gates.cutover_readiness(union([
        check("ORPHANS", orphans),
        check("NULL_STATUS", tgt_orders(t).where("status IS NULL")),
        check("MISSING_ROWS", cmp.missing_rows(src_orders(t), tgt_orders(t), "id")),
    ]))


@query(
    "q08_apply_exceptions",
    f"""WITH d AS ({ROW_DIFF}), r AS (SELECT id, kind, CASE kind WHEN 'changed' THEN 'SEV2' ELSE 'SEV1' END AS severity FROM d),
      e AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1998-01-01')
     SELECT r.id, kind, e.id IS NOT NULL AS suppressed, CASE WHEN e.id IS NOT NULL THEN 'SEV3' ELSE severity END AS severity FROM r LEFT JOIN e ON r.id = e.id""",
)
def excepted(t: Tables):
    report = cmp.row_diff(src_orders(t), tgt_orders(t), ["id"], VALUES).select(
        "id", "kind", F.when(F.col("kind") == "changed", "SEV2").otherwise("SEV1").alias("severity")
    )
    exceptions = t.orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_on"))
    return gates.apply_exceptions(report, exceptions, ["id"], F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).select("id", "kind", "suppressed", "severity")


@query(
    "a36_class_histogram",
    f"""WITH s AS (SELECT o_orderpriority AS p, * FROM {SRC_ORDERS} JOIN (SELECT o_orderkey, o_orderpriority FROM orders) ON id = o_orderkey),
     t AS (SELECT o_orderpriority AS p, * FROM {TGT_ORDERS} JOIN (SELECT o_orderkey, o_orderpriority FROM orders) ON id = o_orderkey),
     a AS (SELECT p, count(*) n, sum({ORDER_HASH}) h, count(*) FILTER (WHERE is_deleted) d FROM s GROUP BY p), b AS (SELECT p, count(*) n, sum({ORDER_HASH}) h, count(*) FILTER (WHERE is_deleted) d FROM t GROUP BY p),
     f AS (SELECT a.n = b.n AS cm, a.h = b.h AS hm, a.d = b.d AS dm FROM a JOIN b USING (p))
     SELECT CASE WHEN NOT cm AND NOT hm THEN 'CLASS-A' WHEN cm AND NOT hm THEN 'CLASS-B' WHEN NOT dm THEN 'CLASS-C' ELSE 'OK' END AS gap_class,
       CASE WHEN NOT cm AND NOT hm THEN 'SEV1' WHEN NOT cm OR NOT hm OR NOT dm THEN 'SEV2' ELSE 'OK' END AS severity, count(*) AS tables FROM f GROUP BY 1, 2""",
)
def histogram(t: Tables):
    prio = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))

    def side(d):
        return d.join(prio, "id").groupBy(F.lit("sales").alias("schema_name"), F.col("p").alias("table_name")).agg(
            F.count(F.lit(1)).alias("row_count"),
            wide_sum(digest_number(row_md5(d, ORDER_COLS))).cast("string").alias("hash_sum"),
            F.lit(0).alias("updated_count"),
            F.count_if("is_deleted").alias("deleted_count"),
        )

    return gates.class_histogram(gates.classify_gaps(cmp.compare_summaries(side(src_orders(t)), side(tgt_orders(t)))))


@query(
    "q02_classify_extended",
    f"""WITH x AS (SELECT id % 10 AS g, count(*) FILTER (WHERE id % 10 <> 4) >= 0 AND id % 10 <> 4 AS om,
        cast(sum({md5_number(id_and("status"))}) AS varchar) sr,
        cast(sum({md5_number(id_and("trim(status)"))}) AS varchar) sc,
        cast(sum({md5_number(id_and("CASE WHEN id % 10 IN (1, 2) THEN status || '  ' WHEN id % 10 = 3 THEN 'X' ELSE status END"))}) AS varchar) tr,
        cast(sum({md5_number(id_and("CASE WHEN id % 10 = 3 THEN 'X' ELSE status END"))}) AS varchar) tc
        FROM {SRC_ORDERS} GROUP BY id % 10)
     SELECT g AS slice, CASE WHEN NOT om THEN 'CLASS-D' WHEN sr <> tr AND sc = tc THEN 'CLASS-E' WHEN sc <> tc THEN 'CLASS-B' ELSE 'OK' END AS extended_class FROM x""",
)
def extended(t: Tables):
    src = src_orders(t).select("id", "status")
    padded = F.when(F.expr("id % 10 IN (1, 2)"), F.concat("status", F.lit("  "))).when(F.expr("id % 10 = 3"), "X").otherwise(F.col("status"))
    tgt = src.withColumn("status", padded)

    def side(d, name):
        raw = digest_number(F.md5(F.concat_ws("|", *raw_columns(d))))
        canonical = digest_number(F.md5(F.concat_ws("|", *canon_columns(d))))
        return d.groupBy(F.expr("id % 10").alias("slice")).agg(
            wide_sum(raw).cast("string").alias(name + "_raw"), wide_sum(canonical).cast("string").alias(name + "_canon")
        )

    pairs = side(src, "source").join(side(tgt, "target"), "slice").withColumn("object_match", F.col("slice") != 4)
    return gates.classify_extended(pairs).select("slice", "extended_class")


@query(
    "u02_key_union",
    f"""SELECT coalesce(s.id, t.id) AS id, s.id IS NOT NULL AS in_source, t.id IS NOT NULL AS in_target FROM {SRC_ORDERS} s FULL OUTER JOIN (SELECT DISTINCT id FROM {TGT_ORDERS_DUP}) t ON s.id = t.id""",
)
def key_union(t: Tables):
    return cmp.key_union(src_orders(t), tgt_orders(t, True), ["id"])
