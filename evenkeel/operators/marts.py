"""Business validation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def money(col: str) -> Column:
    return F.col(col).cast("decimal(15,2)")


def _count() -> Column:
    return F.count(F.lit(1))


def newest(df: DataFrame, ts: str) -> DataFrame:
    """One row with the newest time of a table: the default ``as_of``."""
    return df.agg(F.max(ts).alias("as_of"))


def with_as_of(df: DataFrame, as_of: DataFrame) -> DataFrame:
    """Attach the single as_of value as a scalar subquery."""
    return df.withColumn("as_of", as_of.scalar())


def recent(df: DataFrame, ts: str, interval: str, as_of: DataFrame | None = None) -> DataFrame:
    """Rows newer than ``as_of - interval``."""
    as_of = newest(df, ts) if as_of is None else as_of
    return with_as_of(df, as_of).where(F.col(ts) > F.col("as_of") - F.expr(f"INTERVAL {interval}")).drop("as_of")


def daily_sales(orders: DataFrame, ts: str, amount: str, customer: str, days: int | None = None) -> DataFrame:
    """Orders, revenue and distinct customers per day; the last ``days`` if asked.

    The distinct count is done in two steps, per (day, customer) and then per
    day, so a day or a customer with most of the rows is combined before it moves.
    """
    base = orders
    if days is not None:
        base = with_as_of(orders, newest(orders, ts)).where(F.col(ts) >= F.date_sub(F.to_date("as_of"), days))
    base = base.select(F.to_date(ts).alias("d"), money(amount).alias("a"), F.col(customer).alias("c"))
    per = base.groupBy("d", "c").agg(_count().alias("n"), F.sum("a").alias("s"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    return per.groupBy("d").agg(
        F.sum("n").alias("order_count"),
        F.sum("s").cast("double").alias("gross_revenue"),
        F.min("lo").cast("double").alias("min_amount"),
        F.max("hi").cast("double").alias("max_amount"),
        F.count("c").alias("unique_customers"),
    ).select(F.col("d").cast("string").alias("business_date"), "order_count", "gross_revenue", "min_amount", "max_amount", "unique_customers")


def status_distribution(orders: DataFrame, status: str, amount: str, statuses: Sequence[str], include_null: bool = False) -> DataFrame:
    """Count and revenue per listed status.

    The IN list drops nulls before they can be labelled; ``include_null`` keeps them as UNKNOWN.
    """
    keep = F.col(status).isin(*statuses)
    if include_null:
        keep = keep | F.col(status).isNull()
    return orders.where(keep).groupBy(F.coalesce(F.col(status), F.lit("UNKNOWN")).alias("order_status")).agg(
        _count().alias("order_count"), F.sum(money(amount)).cast("double").alias("status_revenue")
    )


def balance_profile(customers: DataFrame, balance: str) -> DataFrame:
    """Count, total, smallest and largest balance."""
    b = F.col(balance).cast("decimal(18,2)")
    return customers.agg(
        _count().alias("customer_count"),
        F.sum(b).cast("double").alias("total_balance"),
        F.min(b).cast("double").alias("min_balance"),
        F.max(b).cast("double").alias("max_balance"),
    )


def inventory_snapshot(df: DataFrame, site: str, sku: str, quantity: str) -> DataFrame:
    """Distinct items and quantities per site, in two combining steps."""
    q = F.col(quantity).cast("decimal(18,2)")
    per = df.groupBy(site, sku).agg(F.sum(q).alias("s"), F.min(q).alias("lo"), F.max(q).alias("hi"))
    return per.groupBy(site).agg(
        F.count(sku).alias("sku_count"),
        F.sum("s").cast("double").alias("total_quantity"),
        F.min("lo").cast("double").alias("min_quantity"),
        F.max("hi").cast("double").alias("max_quantity"),
    )


def revenue_by_region(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Revenue per region over the star.

    Orders are summed per customer first, so the joins carry one row per customer.
    """
    per = orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("revenue"))
    return (
        per.join(customer.select("c_custkey", "c_nationkey"), per.o_custkey == customer.c_custkey)
        .join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.sum("revenue").cast("double").alias("revenue"))
    )


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of every rule in one pass, one row per rule."""
    one = df.agg(*[F.count_if(c).alias(f"v{i}") for i, c in enumerate(rules.values())])
    rows = [F.struct(F.lit(n).alias("violation_type"), F.col(f"v{i}").alias("violation_count")) for i, n in enumerate(rules)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rows_by_day(df: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows per day of the last ``days``, days without rows included."""
    per = df.groupBy(F.to_date(ts).alias("d")).agg(_count().alias("n"))
    last = per.agg(F.max("d").alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("d"))
    return calendar.join(per, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("row_count"))


def nonzero_balances(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Accounts whose ledger does not add up to zero."""
    return df.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("b")).where("b <> 0").select(key, F.col("b").cast("double").alias("balance"))


def next_sequence(df: DataFrame, pk: str, offset: int = 0) -> DataFrame:
    """The value a sequence has to restart from."""
    return df.agg((F.coalesce(F.max(pk), F.lit(0)) + 1 + offset).cast("long").alias("next_value"))


def top_customers(orders: DataFrame, customer: str, amount: str, ts: str, k: int = 50) -> DataFrame:
    """Highest lifetime revenue, ties by customer."""
    return (
        orders.groupBy(F.col(customer).alias("customer_id"))
        .agg(_count().alias("order_count"), F.sum(money(amount)).alias("r"), F.max(ts).alias("last_order_date"))
        .orderBy(F.desc("r"), "customer_id")
        .limit(k)
        .select("customer_id", "order_count", F.col("r").cast("double").alias("lifetime_revenue"), "last_order_date")
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children without a parent; null references are not orphans."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def childless(parent: DataFrame, child: DataFrame, pk: str, fk: str) -> DataFrame:
    """Parents without a child."""
    return parent.join(child.select(F.col(fk).alias(pk)).distinct(), pk, "left_anti")


def join_integrity(orders: DataFrame, customers: DataFrame, fk: str, pk: str, ts: str, order_id: str, days: int = 7, n: int = 1000) -> DataFrame:
    """Newest ``n`` orders of the last ``days`` with the state of their customer join."""
    window = with_as_of(orders, newest(orders, ts)).where(F.col(ts) >= F.date_sub(F.to_date("as_of"), days)).drop("as_of")
    top = window.orderBy(F.desc(ts), order_id).limit(n)
    c = customers.withColumn("__found", F.lit(True))
    joined = top.join(c, top[fk] == c[pk], "left")
    return joined.withColumn("join_status", F.when(F.col("__found"), "OK").otherwise("ORPHAN")).drop("__found")
