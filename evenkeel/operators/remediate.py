"""Repair of a target inside a key scope, and merging of deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evenkeel.operators.compare import row_diff


def gap_keys(src: DataFrame, tgt: DataFrame, pk: str, cols: Sequence[str]) -> DataFrame:
    """Keys to repair, with the repair each needs (Q04)."""
    names = {"missing": "INSERT", "extra": "DELETE", "changed": "UPDATE"}
    action = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return row_diff(src, tgt, [pk], cols).select(F.col(pk).alias("key_id"), action[F.col("kind")].alias("repair")).distinct()


def remediate(target: DataFrame, src: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """Target with every scoped key replaced by the source's version (Q04).

    Missing rows appear, extra rows go, changed rows are overwritten; keys outside
    the scope stay as they are. ``keys`` is read twice, so hand in a kept list (a
    table or a checkpoint) and not the comparison that finds it. Parquet tables have no MERGE: write the result to a
    new place (or to the touched partitions) and switch.
    """
    scope = keys.select(F.col("key_id").alias(pk)).distinct()
    kept = target.join(scope, pk, "left_anti")
    fixed = src.select(*target.columns).join(scope, pk, "left_semi")
    return kept.unionByName(fixed)


def merge_delta(target: DataFrame, delta: DataFrame, pk: str, op: str = "op_type", with_deletes: bool = True) -> DataFrame:
    """matched I/U -> update, unmatched I/U -> insert, matched D -> delete.

    ``delta`` has at most one row per key (see ``net_changes``). With
    ``with_deletes=False`` deletes are ignored.
    """
    cols = [c for c in target.columns if c != pk]
    d = delta.select(pk, F.col(op).alias("__op"), *[F.col(c).alias("__d_" + c) for c in cols])
    if not with_deletes:
        d = d.where(F.col("__op") != "D")
    # rows without a delta bypass the outer join
    keys = d.select(pk)
    untouched = target.join(keys, pk, "left_anti")
    t = target.join(keys, pk, "left_semi").withColumn("__in", F.lit(True))
    both = t.join(d, pk, "full_outer")
    both = both.where(~(F.coalesce(F.col("__op") == "D", F.lit(False))))
    use = F.col("__op").isin("I", "U")
    out = [F.when(use, F.col("__d_" + c)).otherwise(F.col(c)).alias(c) for c in cols]
    merged = both.where(F.col("__in") | use).select(pk, *out).select(*target.columns)
    return untouched.select(*target.columns).unionByName(merged)
