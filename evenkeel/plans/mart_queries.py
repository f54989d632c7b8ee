"""Business validation marts over orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import marts
from evenkeel.plans.registry import Tables, query

DAILY = """SELECT cast(cast(o_orderdate AS date) AS varchar) AS business_date, count(*) AS order_count, cast(sum(cast(o_totalprice AS decimal(15,2))) AS double) AS gross_revenue,
     cast(min(cast(o_totalprice AS decimal(15,2))) AS double) AS min_amount, cast(max(cast(o_totalprice AS decimal(15,2))) AS double) AS max_amount,
     count(DISTINCT o_custkey) AS unique_customers FROM orders {w} GROUP BY 1"""


@query("a11_daily_sales", DAILY.format(w=""))
def daily(t: Tables):
    return marts.daily_sales(t.orders, "o_orderdate", "o_totalprice", "o_custkey")


@query("a11_daily_sales_30d", DAILY.format(w="WHERE o_orderdate >= (SELECT cast(max(o_orderdate) AS date) - 30 FROM orders)"))
def daily30(t: Tables):
    return marts.daily_sales(t.orders, "o_orderdate", "o_totalprice", "o_custkey", days=30)


STATUS = """SELECT coalesce(s,'UNKNOWN') AS order_status, count(*) AS order_count, cast(sum(cast(o_totalprice AS decimal(15,2))) AS double) AS status_revenue
   FROM (SELECT CASE WHEN o_orderkey % 613 = 11 THEN NULL ELSE o_orderstatus END AS s, o_totalprice FROM orders) WHERE s IN ('O','F'){n} GROUP BY 1"""


def holed(t: Tables):
    return t.orders.withColumn("o_orderstatus", F.when(F.expr("o_orderkey % 613 = 11"), F.lit(None)).otherwise(F.col("o_orderstatus")))


@query("a12_status_distribution", STATUS.format(n=""))
def statuses(t: Tables):
    return marts.status_distribution(holed(t), "o_orderstatus", "o_totalprice", ["O", "F"])


@query("a12_status_distribution_nulls", STATUS.format(n=" OR s IS NULL"))
def statuses_null(t: Tables):
    return marts.status_distribution(holed(t), "o_orderstatus", "o_totalprice", ["O", "F"], include_null=True)


@query(
    "a13_balance_profile",
    """SELECT count(*) AS customer_count, cast(sum(cast(c_acctbal AS decimal(18,2))) AS double) AS total_balance, cast(min(cast(c_acctbal AS decimal(18,2))) AS double) AS min_balance,
     cast(max(cast(c_acctbal AS decimal(18,2))) AS double) AS max_balance FROM customer""",
)
def balances(t: Tables):
    return marts.balance_profile(t.customer, "c_acctbal")


@query(
    "a14_inventory_snapshot",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS sku_count, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS total_quantity,
     cast(min(l_quantity) AS double) AS min_quantity, cast(max(l_quantity) AS double) AS max_quantity FROM lineitem GROUP BY 1""",
)
def inventory(t: Tables):
    return marts.inventory_snapshot(t.lineitem, "l_suppkey", "l_partkey", "l_quantity")


@query(
    "a15_revenue_by_region",
    """SELECT r_name AS region, cast(sum(cast(o_totalprice AS decimal(15,2))) AS double) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def regions(t: Tables):
    return marts.revenue_by_region(t.orders, t.customer, t.nation, t.region)


@query(
    "a16_rule_violations",
    """SELECT 'Negative Amounts' AS violation_type, count(*) AS violation_count FROM customer WHERE c_acctbal < 0
     UNION ALL SELECT 'Null Status', count(*) FROM orders WHERE o_orderkey % 613 = 11
     UNION ALL SELECT 'Future Order Dates', count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'
     UNION ALL SELECT 'Shipped Before Order', count(*) FROM (SELECT l_orderkey, max(l_shipdate) m FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE m < o_orderdate""",
)
def violations(t: Tables):
    future = F.expr("o_orderdate > TIMESTAMP_NTZ '2001-01-01 00:00:00'")
    on_orders = marts.rule_violations(holed(t), {"Null Status": F.col("o_orderstatus").isNull(), "Future Order Dates": future})
    on_customers = marts.rule_violations(t.customer, {"Negative Amounts": F.col("c_acctbal") < 0})
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
    late = t.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    on_lines = marts.rule_violations(late, {"Shipped Before Order": F.col("m") < F.col("o_orderdate")})
    return on_orders.unionByName(on_customers).unionByName(on_lines)


@query(
    "a17_rows_by_day",
    """WITH p AS (SELECT cast(ts AS date) d, count(*) n FROM events WHERE dayofweek(ts) <> 0 GROUP BY 1), c AS (SELECT cast(unnest(generate_series(max(d) - INTERVAL 29 DAY, max(d), INTERVAL 1 DAY)) AS date) d FROM p)
     SELECT cast(c.d AS varchar) AS day, coalesce(n, 0) AS row_count FROM c LEFT JOIN p ON c.d = p.d""",
)
def days(t: Tables):
    return marts.rows_by_day(t.events.where("dayofweek(ts) <> 1"), "ts", 30)


LEDGER = """(SELECT event_id, user_id AS account, cast(value AS decimal(18,2)) AS amount FROM events
   UNION ALL SELECT event_id, user_id, -cast(value AS decimal(18,2)) FROM events WHERE event_id % 777 <> 0)"""


@query("a18_nonzero_balances", f"SELECT account, cast(sum(amount) AS double) AS balance FROM {LEDGER} GROUP BY 1 HAVING sum(amount) <> 0")
def ledger(t: Tables):
    legs = t.events.select("event_id", F.col("user_id").alias("account"), F.col("value").cast("decimal(18,2)").alias("a"))
    both = legs.select("account", F.explode(F.array_compact(F.array(F.col("a"), F.when(F.expr("event_id % 777 <> 0"), -F.col("a"))))).alias("amount"))
    return marts.nonzero_balances(both, "account", "amount")


@query("a19_next_sequence", "SELECT max(o_orderkey) + 1 AS next_value FROM orders")
def sequence(t: Tables):
    return marts.next_sequence(t.orders, "o_orderkey")


@query(
    "t02_top_customers",
    """SELECT o_custkey AS customer_id, count(*) AS order_count, cast(sum(cast(o_totalprice AS decimal(15,2))) AS double) AS lifetime_revenue, max(o_orderdate) AS last_order_date
     FROM orders GROUP BY 1 ORDER BY sum(cast(o_totalprice AS decimal(15,2))) DESC, 1 LIMIT 50""",
)
def best(t: Tables):
    return marts.top_customers(t.orders, "o_custkey", "o_totalprice", "o_orderdate")


ORPHANED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 331 = 1 THEN -o_orderkey - 1 ELSE o_custkey END AS o_custkey, o_orderdate FROM orders)"


def orphaned(t: Tables):
    return t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 331 = 1 THEN -o_orderkey - 1 ELSE o_custkey END AS o_custkey", "o_orderdate")


@query("j09_orphans", f"SELECT o_orderkey, o_custkey FROM {ORPHANED} o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
def orphan_rows(t: Tables):
    return marts.orphans(orphaned(t), t.customer, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("j09_orphan_count", f"SELECT count(*) AS orphan_count FROM {ORPHANED} o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
def orphan_count(t: Tables):
    return marts.orphans(orphaned(t), t.customer, "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("orphan_count"))


@query("j10_childless", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def no_lines(t: Tables):
    return marts.childless(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query(
    "j11_join_integrity",
    f"""SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS customer_name, o_orderdate, CASE WHEN c_custkey IS NULL THEN 'ORPHAN' ELSE 'OK' END AS join_status
     FROM (SELECT * FROM {ORPHANED} WHERE o_orderdate >= (SELECT cast(max(o_orderdate) AS date) - 90 FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000) LEFT JOIN customer ON c_custkey = o_custkey""",
)
def integrity(t: Tables):
    out = marts.join_integrity(orphaned(t), t.customer, "o_custkey", "c_custkey", "o_orderdate", "o_orderkey", days=90)
    return out.select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("")).alias("customer_name"), "o_orderdate", "join_status")


@query("p08_recent", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def last_week(t: Tables):
    return marts.recent(t.orders, "o_orderdate", "7 DAYS").select("o_orderkey")
