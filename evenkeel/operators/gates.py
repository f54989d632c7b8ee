"""Gap classes, tolerances, readiness and approved exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Class codes and the action text that belongs to each.
ACTIONS = {
    "CLASS-A": "Re-extract and replay missing/extra key ranges; then hash validate",
    "CLASS-B": "Run row-level diff and targeted UPDATE remediation",
    "CLASS-C": "Replay CDC from safe checkpoint and validate operation parity",
    "OK": "No remediation required",
}


def _flag(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) == "true"


def classify_gaps(report: DataFrame, mode: str = "code") -> DataFrame:
    """Gap class and action per compared table (Q01).

    ``code``: a count-only mismatch is not class A. ``documented``: it is.
    """
    count, digest = _flag("count_match"), _flag("hash_match")
    a = ~count if mode == "documented" else ~count & ~digest
    cls = (
        F.when(a, "CLASS-A")
        .when(count & ~digest, "CLASS-B")
        .when(~_flag("update_match") | ~_flag("delete_match"), "CLASS-C")
        .otherwise("OK")
    )
    actions = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return report.withColumn("gap_class", cls).withColumn("recommended_action", actions[F.col("gap_class")])


def class_histogram(classified: DataFrame) -> DataFrame:
    """Tables per gap class and severity."""
    return classified.groupBy("gap_class", "severity").agg(F.count(F.lit(1)).alias("tables"))


def classify_extended(pairs: DataFrame) -> DataFrame:
    """CLASS-D for objects, CLASS-E where only the raw form differs (Q02).

    Expects object_match plus raw and canonical fingerprints of both sides.
    """
    raw = F.col("source_raw").eqNullSafe(F.col("target_raw"))
    canonical = F.col("source_canon").eqNullSafe(F.col("target_canon"))
    cls = F.when(~F.col("object_match"), "CLASS-D").when(~raw & canonical, "CLASS-E").when(~canonical, "CLASS-B").otherwise("OK")
    return pairs.withColumn("extended_class", cls)


def tolerance_gate(compared: DataFrame, tolerances: dict[str, float], scope: str = "scope") -> DataFrame:
    """Percent difference against the tolerance of the row's scope (Q06)."""
    allowed = F.create_map(*[x for k, v in tolerances.items() for x in (F.lit(k), F.lit(float(v)))])
    diff = F.abs(F.col("target_value") - F.col("source_value"))
    pct = F.when(diff == 0, F.lit(0.0)).when(F.col("source_value") == 0, F.lit(100.0)).otherwise(
        F.round(F.lit(100.0) * diff.cast("double") / F.abs(F.col("source_value")).cast("double"), 6)
    )
    out = compared.withColumn("diff_pct", pct).withColumn("tolerance_pct", allowed[F.col(scope)])
    return out.withColumn("status", F.when(F.col("diff_pct") <= F.col("tolerance_pct"), "PASS").otherwise("FAIL"))


def cutover_readiness(checks: DataFrame) -> DataFrame:
    """PASS/FAIL per check from its real count of violations, and the overall answer (Q07)."""
    return checks.groupBy("check_name").agg(F.sum("violations").alias("violations")).select(
        "check_name", "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status")
    )


def apply_exceptions(report: DataFrame, exceptions: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Unexpired approved exceptions lower a finding to SEV3 (Q08)."""
    live = exceptions.where(F.col("expires_on") >= as_of).select(*keys).distinct().withColumn("__approved", F.lit(True))
    joined = report.join(live, list(keys), "left")
    approved = F.coalesce("__approved", F.lit(False)) & (F.col("severity") != "OK")
    return joined.withColumn("suppressed", approved).withColumn(
        "severity", F.when(approved, "SEV3").otherwise(F.col("severity"))
    ).drop("__approved")
