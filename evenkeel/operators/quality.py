"""Contracts, drift, freshness and audits (Q09-Q19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.session import cut_lineage

# Column types that a migration cannot carry over safely.
UNSUPPORTED_TYPES = ["text", "ntext", "image", "sql_variant", "hierarchyid", "geography", "geometry"]


def keys_present(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """True iff every JSON document carries the key; empty input is true (Q09)."""
    present = F.array_contains(F.json_object_keys(F.col(json_col)), key)
    return df.agg(F.coalesce(F.bool_and(F.coalesce(present, F.lit(False))), F.lit(True)).alias("all_present"))


def check_contract(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Rows with ``valid`` and the ``reason`` of the first rules broken (Q10).

    ``contract`` maps a required column to the type its value must coerce to.
    """
    reasons = [
        F.when(F.col(c).isNull(), F.lit(f"{c}: missing")).when(F.expr(f"try_cast(`{c}` AS {dtype}) IS NULL"), F.lit(f"{c}: not {dtype}"))
        for c, dtype in contract.items()
    ]
    out = df.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), "; "))
    return out.withColumn("valid", F.col("reason") == "")


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema of a DataFrame as rows; its size is the number of columns."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


# Widenings that keep every value.
COMPATIBLE = [("int", "bigint"), ("float", "double"), ("int", "double"), ("smallint", "int"), ("tinyint", "int"), ("date", "timestamp")]


def schema_drift(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """Added, removed and retyped columns, and whether the change is safe (Q11)."""
    o = old.select(*keys, F.col("data_type").alias("old_type"))
    n = new.select(*keys, F.col("data_type").alias("new_type"))
    both = o.join(n, list(keys), "full_outer")
    kind = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    safe = F.concat_ws(">", "old_type", "new_type").isin(*[f"{a}>{b}" for a, b in COMPATIBLE])
    return both.withColumn("change", kind).where(F.col("change").isNotNull()).withColumn(
        "compatible", (F.col("change") == "added") | ((F.col("change") == "retyped") & safe)
    )


def freshness(df: DataFrame, ts: str, keys: Sequence[str], sla_minutes: float, as_of: DataFrame) -> DataFrame:
    """Minutes since the newest row of each source against its limit (Q12)."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("newest"))
    lag = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / F.lit(6e7)
    out = newest.withColumn("as_of", as_of.scalar()).withColumn("lag_minutes", lag)
    return out.withColumn("status", F.when(F.col("lag_minutes") <= sla_minutes, "FRESH").otherwise("STALE")).drop("as_of")


def type_audit(columns: DataFrame, unsupported: Sequence[str] = UNSUPPORTED_TYPES) -> DataFrame:
    """Columns whose type needs attention (Q13)."""
    kind = F.lower("data_type")
    flag = F.when(kind.isin(*unsupported), "UNSUPPORTED").when(kind.isin("unknown", ""), "UNKNOWN").otherwise("OK")
    return columns.withColumn("audit", flag)


def not_null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Required columns that hold nulls (Q14)."""
    from evenkeel.operators.fingerprint import null_counts

    return null_counts(df, cols).where("null_count > 0")


def restore_check(prod: DataFrame, restored: DataFrame, pk: str, hash_cols: Sequence[str], max_variance_pct: float = 1.0) -> DataFrame:
    """Row variance, checksum and newest key of a restored table (Q15)."""
    from evenkeel.functions.canon import digest_number, row_md5, wide_sum

    def tagged(df: DataFrame, is_prod: bool) -> DataFrame:
        return df.select(F.col(pk).alias("k"), digest_number(row_md5(df, hash_cols)).alias("h"), F.lit(is_prod).alias("p"))

    p = F.col("p")
    both = tagged(prod, True).unionByName(tagged(restored, False)).agg(
        F.count_if(p).alias("p_rows"),
        F.count_if(~p).alias("r_rows"),
        F.max(F.when(p, F.col("k"))).alias("p_max"),
        F.max(F.when(~p, F.col("k"))).alias("r_max"),
        wide_sum(F.when(p, F.col("h"))).alias("p_hash"),
        wide_sum(F.when(~p, F.col("h"))).alias("r_hash"),
    )
    variance = F.round(F.coalesce(F.try_divide(F.abs(F.col("r_rows") - F.col("p_rows")) * 100.0, F.col("p_rows")), F.lit(0.0)), 4)
    checks = F.array(
        F.struct(F.lit("ROW_VARIANCE").alias("check_name"), variance.cast("string").alias("observed"), (variance < max_variance_pct).alias("ok")),
        F.struct(F.lit("CHECKSUM").alias("check_name"), F.col("r_hash").cast("string").alias("observed"), F.col("p_hash").eqNullSafe(F.col("r_hash")).alias("ok")),
        F.struct(F.lit("MAX_ID").alias("check_name"), F.col("r_max").cast("string").alias("observed"), F.col("p_max").eqNullSafe(F.col("r_max")).alias("ok")),
    )
    return both.select(F.explode(checks).alias("c")).select("c.check_name", "c.observed", F.when(F.col("c.ok"), "PASS").otherwise("FAIL").alias("status"))


def unused_indexes(usage: DataFrame, min_scans: int = 10) -> DataFrame:
    """Indexes hardly ever scanned, largest first at the sink (Q16)."""
    kind = F.when(F.col("idx_scan") == 0, "UNUSED").otherwise("RARELY_USED")
    return usage.where(F.col("idx_scan") < min_scans).withColumn("finding", kind)


def redundant_indexes(usage: DataFrame) -> DataFrame:
    """Index groups of a table with the same leading column; the most used one is kept (Q16)."""
    lead = F.split("index_columns", ",")[0]
    grouped = usage.groupBy("table_name", lead.alias("leading_column")).agg(
        F.count(F.lit(1)).alias("index_count"), F.max_by("index_name", F.struct("idx_scan", "index_name")).alias("keep_index")
    )
    return grouped.where("index_count > 1")


def seek_share(usage: DataFrame) -> DataFrame:
    """Seeks as percent of all index accesses (Q16)."""
    total = F.col("seeks") + F.col("scans") + F.col("lookups") + F.col("updates")
    return usage.withColumn("seek_pct", F.round(F.try_divide(F.col("seeks") * F.lit(100.0), total), 1))


def access_audit(members: DataFrame, roles: DataFrame, principals: DataFrame, privileged: Sequence[str]) -> DataFrame:
    """Role members with a finding: privileged, disabled or plain (Q17)."""
    joined = members.join(roles, "role_id").join(principals, "principal_id")
    finding = (
        F.when(F.col("is_disabled") & F.col("role_name").isin(*privileged), "DISABLED_PRIVILEGED")
        .when(F.col("role_name").isin(*privileged), "PRIVILEGED")
        .when(F.col("is_disabled"), "DISABLED")
        .otherwise("OK")
    )
    return joined.withColumn("finding", finding)


def config_drift(prev: DataFrame, cur: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Parameters that changed, appeared or went away (Q18)."""
    p = prev.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_prev"))
    c = cur.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_cur"))
    both = p.join(c, list(keys), "full_outer")
    change = (
        F.when(F.col("in_prev").isNull(), "ADDED")
        .when(F.col("in_cur").isNull(), "REMOVED")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "CHANGED")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("in_prev", "in_cur")


def stale_stats(df: DataFrame, analyzed: str, max_age_days: int, as_of: DataFrame) -> DataFrame:
    """Tables never analysed, flagged stale, or analysed too long ago (Q19)."""
    age = F.date_diff(F.to_date("as_of"), F.to_date(analyzed))
    reason = (
        F.when(F.col(analyzed).isNull(), "NEVER_ANALYZED").when(F.col("stale_stats") == "YES", "FLAGGED").when(age > max_age_days, "TOO_OLD")
    )
    return df.withColumn("as_of", as_of.scalar()).withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("as_of")


def inherited_roles(grants: DataFrame, member: str = "member_role_id", role: str = "role_id") -> DataFrame:
    """``member, role, path, depth``: every role that a role holds over others, by the shortest way (Q17).

    ``grants`` has a row for each role that is a member of another. Of equally short ways
    the least path counts; a cycle gives each of its roles the others, and itself, once.
    Rounds follow the pairs that are new, so they are as many as the longest shortest way.
    """
    links = cut_lineage(grants.select(member, role).distinct())
    path = F.array(F.col(member), F.col(role))
    found = fresh = cut_lineage(links.select(member, role, path.alias("path"), F.lit(1).alias("depth")))
    onward = links.select(F.col(member).alias("__via"), F.col(role).alias("__next"))
    while not fresh.isEmpty():
        step = fresh.join(onward, fresh[role] == onward["__via"])
        longer = step.select(member, F.col("__next").alias(role), F.array_append("path", F.col("__next")).alias("path"), (F.col("depth") + 1).alias("depth"))
        best = longer.groupBy(member, role).agg(F.min("path").alias("path"), F.min("depth").alias("depth"))
        fresh = cut_lineage(best.join(found.select(member, role), [member, role], "left_anti"))
        found = cut_lineage(found.unionByName(fresh))
    return found


def inherited_privileges(members: DataFrame, grants: DataFrame, roles: DataFrame, principals: DataFrame, privileged: Sequence[str]) -> DataFrame:
    """Each principal's roles, direct and inherited, with the way to them and a finding (Q17).

    ``members`` (principal_id, role_id) are direct memberships. The closure is taken over
    the roles, which are few, and joined to the members once.
    """
    closure = inherited_roles(grants).select(F.col("member_role_id").alias("__direct"), F.col("role_id").alias("__role"), "path", "depth")
    direct = members.select("principal_id", "role_id", F.array("role_id").alias("path"), F.lit(0).alias("depth"))
    over = members.join(closure, members["role_id"] == closure["__direct"]).select("principal_id", F.col("__role").alias("role_id"), "path", "depth")
    every = direct.unionByName(over).groupBy("principal_id", "role_id").agg(F.min(F.struct("depth", "path")).alias("way"))
    return access_audit(every.select("principal_id", "role_id", "way.depth", "way.path"), roles, principals, privileged)
