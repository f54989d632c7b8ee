"""Profiles and fingerprints of one table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions.canon import canon, canon_columns, digest_number, row_md5, row_text, wide_sum


def key_hash(df: DataFrame, pk: Sequence[str] | str) -> Column:
    names = [pk] if isinstance(pk, str) else list(pk)
    return digest_number(F.md5(F.concat_ws("|", *canon_columns(df, names))))


def bucket_of(df: DataFrame, pk: Sequence[str] | str, modulus: int) -> Column:
    return F.pmod(key_hash(df, pk), F.lit(modulus)).cast("int")


def row_profile(df: DataFrame, table: str, pk: str) -> DataFrame:
    """Row count, null keys, smallest and largest key as text."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(pk).isNull()).alias("null_pk_count"),
        F.min(pk).cast("string").alias("min_pk"),
        F.max(pk).cast("string").alias("max_pk"),
    ).select(F.lit(table).alias("table_name"), "*")


def bucket_hash(df: DataFrame, table: str, pk: str, cols: Sequence[str] | None = None, modulus: int = 1024) -> DataFrame:
    """Count, XOR and sum of row hashes per key bucket.

    XOR alone cancels pairs of equal rows, so it always comes with count and sum.
    The bucket count is fixed by ``modulus``: partial aggregation leaves at most
    that many rows per task for the shuffle, whatever the skew.
    """
    return bucket_sums(df, bucket_of(df, pk, modulus), pk, cols).select(F.lit(table).alias("table_name"), "*")


def bucket_sums(df: DataFrame, bucket: Column, pk: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Fingerprint of each bucket."""
    hashed = df.select(bucket.alias("bucket_id"), F.col(pk).alias("__pk"), digest_number(row_md5(df, cols)).alias("__h"))
    return hashed.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("__h").alias("bucket_checksum"),
        wide_sum(F.col("__h")).cast("string").alias("hash_sum"),
        F.min("__pk").cast("string").alias("min_pk"),
        F.max("__pk").cast("string").alias("max_pk"),
    )


@dataclass(frozen=True)
class Rule:
    """One business aggregate: function of a column under a predicate."""

    rule_name: str
    column: str
    agg_fn: str
    predicate: str = "1=1"


def _rule_value(df: DataFrame, rule: Rule) -> Column:
    """Aggregate as text; null for an unknown function or a rule that cannot run."""
    value = f"try_cast(`{rule.column}` AS DECIMAL(38,6))"
    text = {
        "SUM": f"CAST(try_sum(CASE WHEN {rule.predicate} THEN {value} END) AS STRING)",
        "MIN": f"CAST(min(CASE WHEN {rule.predicate} THEN {value} END) AS STRING)",
        "MAX": f"CAST(max(CASE WHEN {rule.predicate} THEN {value} END) AS STRING)",
        "COUNT": f"CAST(count_if({rule.predicate}) AS STRING)",
    }.get(rule.agg_fn.upper())
    if text is None or (rule.agg_fn.upper() != "COUNT" and rule.column not in df.columns):
        return F.lit(None).cast("string")
    column = F.expr(text)
    try:
        df.agg(column).schema
    except AnalysisException:
        return F.lit(None).cast("string")
    return column


def business_profile(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules of a table in one scan and one aggregation, one row per rule."""
    one = df.agg(*[_rule_value(df, r).alias(f"v{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(F.lit(r.rule_name).alias("rule_name"), F.lit(r.agg_fn).alias("agg_fn"), F.col(f"v{i}").alias("agg_value"))
        for i, r in enumerate(rules)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_summary(
    df: DataFrame,
    schema: str,
    table: str,
    cols: Sequence[str] | None,
    updated: str,
    deleted: Column,
    start: Column | None = None,
    end: Column | None = None,
    run_ts: Column | None = None,
) -> DataFrame:
    """Count, order-free hash sum, updates in [start, end) and soft deletes."""
    changed = F.lit(True)
    if start is not None:
        changed = changed & (F.col(updated) >= start)
    if end is not None:
        changed = changed & (F.col(updated) < end)
    out = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        wide_sum(digest_number(row_md5(df, cols))).cast("string").alias("hash_sum"),
        F.count_if(changed & F.col(updated).isNotNull()).alias("updated_count"),
        F.count_if(deleted).alias("deleted_count"),
    ).select(F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "*")
    return out if run_ts is None else out.withColumn("run_ts", run_ts)


def ordered_checksum(df: DataFrame, pk: str, cols: Sequence[str] | None = None, rows_per_block: int = 1000) -> DataFrame:
    """Order-sensitive digest in levels, for whole tables of any size.

    A key's rows are first reduced to their count, extreme digests and digest sum,
    so copies of a key stay one entry however many there are. Entries are joined in
    key order inside key blocks, block digests per group of blocks, and so on. A
    block holds at most ``rows_per_block`` integer keys. Both sides must use the
    same block size.
    """
    if not isinstance(df.schema[pk].dataType, T.IntegralType):
        raise TypeError("ordered_checksum needs an integer key; use bucket_hash otherwise")
    size = rows_per_block
    rows = df.select(F.col(pk).alias("__pk"), row_md5(df, cols).alias("__d"))
    per_key = rows.groupBy("__pk").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__d").alias("__lo"), F.max("__d").alias("__hi"), wide_sum(digest_number(F.col("__d"))).alias("__s")
    )
    entry = F.concat_ws("*", "__n", "__lo", "__hi", "__s")
    rolled = per_key.select("__pk", "__n", entry.alias("__d"), F.expr(f"__pk div {size}").alias("__b")).groupBy("__b").agg(
        F.sum("__n").alias("row_count"), _digest_list(F.struct("__pk", "__d"), lambda x: x["__d"]).alias("__d")
    )
    for _ in range(levels_above(size)):
        rolled = rolled.withColumn("__g", F.expr(f"__b div {size}")).groupBy("__g").agg(
            F.sum("row_count").alias("row_count"), _digest_list(F.struct("__b", "__d"), lambda x: x["__d"]).alias("__d")
        ).withColumnRenamed("__g", "__b")
    final = rolled.agg(
        F.sum("row_count").alias("row_count"), _digest_list(F.struct("__b", "__d"), lambda x: x["__d"]).alias("checksum")
    )
    return final


def levels_above(size: int) -> int:
    """Levels after the first that bring any spread of 64-bit keys down to one block."""
    return math.ceil(64 / math.log2(size)) - 1


def _digest_list(entry: Column, text) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), text), "||"), 256)


def row_digests(df: DataFrame, pk: str, cols: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """SHA-256 of each row's canonical text; the first ``n`` by key if asked."""
    out = df.select(F.col(pk).alias("pk"), F.sha2(row_text(df, cols, ","), 256).alias("row_sha256"))
    return out if n is None else out.orderBy("pk", "row_sha256").limit(n)


def key_coverage(df: DataFrame, pk: str, ts: str, start: Column, end: Column) -> DataFrame:
    """Key range and rows of a half-open time window."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end)).agg(
        F.min(pk).alias("min_pk"), F.max(pk).alias("max_pk"), F.count(F.lit(1)).alias("rows_in_window")
    )


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls of every column in one pass, one row per column."""
    names = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names])
    rows = [F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("null_count")) for n in names]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Full keys held by more than one row."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def distinct_keys(df: DataFrame, pk: Sequence[str], approx: bool = False) -> DataFrame:
    """Row count and distinct full keys (A10); ``approx`` is a cheap first pass."""
    key = F.struct(*pk)
    if approx:
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.approx_count_distinct(F.xxhash64(*pk)).alias("distinct_keys"))
    per_key = df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
    )


def sample_rows(df: DataFrame, pk: str, pct: int = 10) -> DataFrame:
    """The same share of keys on every side: hash of the key, not a random draw."""
    return df.where(F.pmod(key_hash(df, pk), F.lit(100)) < pct)
