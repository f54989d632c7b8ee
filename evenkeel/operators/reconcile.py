"""One reconciliation run over a list of tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.canon import row_md5
from evenkeel.operators.compare import compare_buckets, compare_business
from evenkeel.operators.fingerprint import Rule, bucket_hash, bucket_of, business_profile
from evenkeel.operators.gates import classify_gaps, tolerance_gate
from evenkeel.session import cut_lineage

# Percent of rows that may differ.
TOLERANCES = {"critical": 0.0, "non_critical": 0.01}


@dataclass(frozen=True)
class Scope:
    """A table to reconcile: its key, the columns that count, the number of buckets, and how strict to be.

    ``updated`` names the column of the last change and ``deleted`` is a predicate for
    soft deletes; ``rules`` are business aggregates that have to agree.
    """

    table: str
    key: str
    columns: Sequence[str] | None = None
    modulus: int = 1024
    critical: bool = True
    updated: str | None = None
    deleted: str | None = None
    rules: Sequence[Rule] = ()


def differing_rows(s: Scope, sides: Sequence[DataFrame], bad: DataFrame) -> DataFrame:
    """``missing, extra, changed``: rows that differ, from the row digests in the bad buckets; equal rows cancel."""

    wanted = bad.where(F.col("table_name") == s.table).select(F.col("bucket_id").alias("__bad"))

    def marks(df: DataFrame, weight: int) -> DataFrame:
        # the bucket needs the key only: rows of good buckets leave before their digest is made
        in_bad = df.join(wanted, bucket_of(df, s.key, s.modulus) == F.col("__bad"), "left_semi")
        return in_bad.select(F.col(s.key).alias("key"), row_md5(df, s.columns).alias("digest"), F.lit(weight).alias("w"))

    both = marks(sides[0], 1).unionByName(marks(sides[1], -1))
    net = both.groupBy("key", "digest").agg(F.sum("w").alias("net")).where("net <> 0")
    per_key = net.groupBy("key").agg(F.sum(F.greatest("net", F.lit(0))).alias("less"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("more"))
    changed = F.least("less", "more")
    return per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("missing", F.col("less") - changed), ("extra", F.col("more") - changed), ("changed", changed))])


def operation_profile(s: Scope, df: DataFrame) -> DataFrame:
    """One row: number of stamped rows and last change, number of soft deletes; null for what the scope does not name."""
    stamped = F.struct(F.count(s.updated).alias("n"), F.max(s.updated).alias("last")) if s.updated else F.lit(None)
    return df.agg(F.to_json(F.struct(stamped.alias("v"))).alias("updates"), (F.count_if(F.expr(s.deleted)) if s.deleted else F.lit(None).cast("long")).alias("deletes"))


def reconcile(scopes: Sequence[Scope], source: Callable[[str], DataFrame], target: Callable[[str], DataFrame], tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """Fingerprint, compare, classify and gate every table of the scope: one report row each.

    Row counts come from the bucket hashes; rows of bad buckets are compared by key. A
    table passes if all buckets and operations agree, and passes with tolerance if its
    missing, extra and changed rows together stay within its scope's share of the source
    rows. A business rule that does not agree fails the table.
    """

    def one(s: Scope) -> DataFrame:
        sides = [bucket_hash(side(s.table), s.table, s.key, s.columns, s.modulus) for side in (source, target)]
        return compare_buckets(*sides).withColumn("scope", F.lit("critical" if s.critical else "non_critical"))

    buckets = cut_lineage(reduce(DataFrame.unionByName, map(one, scopes)))  # a row for each bucket
    bad = buckets.where("status <> 'PASS'").select("table_name", "bucket_id")

    def details(s: Scope) -> DataFrame:
        sides = [side(s.table) for side in (source, target)]
        profiles = reduce(DataFrame.unionByName, [operation_profile(s, d) for d in sides])
        same = profiles.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(n) for c, n in (("updates", "update_match"), ("deletes", "delete_match"))])
        parts = [differing_rows(s, sides, bad), same]
        if s.rules:
            parts.append(compare_business(*(business_profile(d, s.rules) for d in sides)).agg(F.count_if(F.col("status") != "PASS").alias("bad_rules")))
        else:
            parts[1] = same.withColumn("bad_rules", F.lit(0).cast("long"))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select(F.lit(s.table).alias("table_name"), *found)

    found = ["missing", "extra", "changed", "update_match", "delete_match", "bad_rules"]
    every = reduce(DataFrame.unionByName, map(details, scopes)).groupBy("table_name").agg(*[F.max(c).alias(c) for c in found])  # each is in one of a table's rows
    total = [F.sum(F.coalesce(f"{side}_row_count", F.lit(0))).alias(f"{side}_rows") for side in ("source", "target")]
    tables = buckets.groupBy("table_name", "scope").agg(*total, F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("status") != "PASS").alias("bad_buckets"))
    tables = tables.join(every, "table_name")
    flagged = tables.withColumns(
        {
            "count_match": F.col("source_rows") == F.col("target_rows"),
            "hash_match": F.col("bad_buckets") == 0,
            "differing_rows": F.col("missing") + F.col("extra") + F.col("changed"),
            "source_value": F.col("source_rows"),
            "target_value": F.col("target_rows"),
        }
    )
    gated = tolerance_gate(classify_gaps(flagged), tolerances)
    within = 100.0 * F.col("differing_rows") <= F.col("tolerance_pct") * F.col("source_rows")
    status = (
        F.when((F.col("bad_rules") > 0) | (F.col("gap_class") == "CLASS-C"), "FAIL")
        .when(F.col("bad_buckets") == 0, "PASS")
        .when(within, "PASS_WITH_TOLERANCE")
        .otherwise("FAIL")
    )
    return gated.select("table_name", "scope", "source_rows", "target_rows", "buckets", "bad_buckets", "gap_class", "recommended_action", "diff_pct", "tolerance_pct", status.alias("status"), *found)
