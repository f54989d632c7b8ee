"""Source against target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.functions.canon import canon_columns, row_md5
from evenkeel.operators.fingerprint import bucket_sums, sample_rows


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def compare_row_profiles(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Profiles side by side with the first failing check as status."""
    cols = ["table_name", "row_count", "null_pk_count"]
    s = _prefixed(src.select(*cols).withColumn("seen", F.lit(True)), "source_", ["table_name"])
    t = _prefixed(tgt.select(*cols).withColumn("seen", F.lit(True)), "target_", ["table_name"])
    status = (
        F.when(F.col("source_seen").isNull() | F.col("target_seen").isNull(), "FAIL_MISSING_TABLE")
        .when(_differs("source_row_count", "target_row_count"), "FAIL_ROW_COUNT")
        .when(_differs("source_null_pk_count", "target_null_pk_count"), "FAIL_NULL_PK")
        .otherwise("PASS")
    )
    zero = F.lit(0)
    return s.join(t, "table_name", "full_outer").select(
        "table_name",
        "source_row_count",
        "target_row_count",
        (F.coalesce("target_row_count", zero) - F.coalesce("source_row_count", zero)).alias("row_count_diff"),
        F.col("source_null_pk_count").alias("source_null_pk"),
        F.col("target_null_pk_count").alias("target_null_pk"),
        status.alias("status"),
    )


def compare_buckets(src: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("table_name", "bucket_id")) -> DataFrame:
    """Bucket by bucket: missing, count, checksum, pass."""
    keys = list(keys)
    cols = [*keys, "row_count", "bucket_checksum", "hash_sum"]
    s = _prefixed(src.select(*cols).withColumn("seen", F.lit(True)), "source_", keys)
    t = _prefixed(tgt.select(*cols).withColumn("seen", F.lit(True)), "target_", keys)
    status = (
        F.when(F.col("source_seen").isNull() | F.col("target_seen").isNull(), "FAIL_MISSING_BUCKET")
        .when(_differs("source_row_count", "target_row_count"), "FAIL_BUCKET_ROW_COUNT")
        .when(
            _differs("source_bucket_checksum", "target_bucket_checksum") | _differs("source_hash_sum", "target_hash_sum"),
            "FAIL_BUCKET_HASH",
        )
        .otherwise("PASS")
    )
    return s.join(t, keys, "full_outer").select(*keys, "source_row_count", "target_row_count", status.alias("status"))


def compare_business(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rule values as text, null shown as ``<null>``."""
    keys = ["rule_name", "agg_fn"]
    s = _prefixed(src.withColumn("seen", F.lit(True)), "source_", keys)
    t = _prefixed(tgt.withColumn("seen", F.lit(True)), "target_", keys)
    sv = F.coalesce("source_agg_value", F.lit("<null>"))
    tv = F.coalesce("target_agg_value", F.lit("<null>"))
    status = (
        F.when(F.col("source_seen").isNull() | F.col("target_seen").isNull(), "FAIL_MISSING_RULE")
        .when(sv != tv, "FAIL_AGG_MISMATCH")
        .otherwise("PASS")
    )
    return s.join(t, keys, "full_outer").select(*keys, sv.alias("source_value"), tv.alias("target_value"), status.alias("status"))


def last_row_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key, the one with the highest position (partial aggregation, no window)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), position).alias("r")).select(*keys, "r.*")


def compare_summaries(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Table summaries: match flags, sparse deltas and severity."""
    keys = ["schema_name", "table_name"]
    nums = ["row_count", "updated_count", "deleted_count"]

    def side(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*keys, *nums, "hash_sum")
        return _prefixed(d, p, keys)

    both = side(src, "s_").join(side(tgt, "t_"), keys, "full_outer")
    for n in nums:
        for p in ("s_", "t_"):
            both = both.withColumn(p + n, F.coalesce(F.col(p + n).cast("long"), F.lit(0)))
    for p in ("s_", "t_"):
        both = both.withColumn(p + "hash_sum", F.coalesce(F.col(p + "hash_sum").cast("string"), F.lit("")))

    def delta(n: str, name: str) -> Column:
        d = F.col("t_" + n) - F.col("s_" + n)
        return F.when(d != 0, d).alias(name)

    out = both.select(
        *keys,
        (F.col("s_row_count") == F.col("t_row_count")).alias("count_match"),
        (F.col("s_hash_sum") == F.col("t_hash_sum")).alias("hash_match"),
        (F.col("s_updated_count") == F.col("t_updated_count")).alias("update_match"),
        (F.col("s_deleted_count") == F.col("t_deleted_count")).alias("delete_match"),
        F.to_json(
            F.struct(
                delta("row_count", "row_count_delta"),
                delta("updated_count", "update_delta"),
                delta("deleted_count", "delete_delta"),
            )
        ).alias("deltas"),
    )
    count, digest = F.col("count_match"), F.col("hash_match")
    severity = (
        F.when(~count & ~digest, "SEV1")
        .when(~count | ~digest, "SEV2")
        .when(~F.col("update_match") | ~F.col("delete_match"), "SEV2")
        .otherwise("OK")
    )
    return out.withColumn("severity", severity)


def key_union(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side, and where it occurs (U02); one aggregation, no join."""
    both = src.select(*keys, F.lit(True).alias("s"), F.lit(False).alias("t")).unionByName(tgt.select(*keys, F.lit(False).alias("s"), F.lit(True).alias("t")))
    return both.groupBy(*keys).agg(F.bool_or("s").alias("in_source"), F.bool_or("t").alias("in_target"))


def in_scope(df: DataFrame, gap_keys: DataFrame, pk: str) -> DataFrame:
    """Rows whose key is in the gap list (J07); AQE broadcasts the list only when it is small."""
    return df.join(gap_keys.select(F.col("key_id").alias(pk)).distinct(), pk, "left_semi")


def missing_rows(src: DataFrame, tgt: DataFrame, pk: str, scope: DataFrame | None = None) -> DataFrame:
    """Source rows with no target row."""
    out = src.join(tgt.select(pk).distinct(), pk, "left_anti")
    return out if scope is None else in_scope(out, scope, pk)


def extra_rows(src: DataFrame, tgt: DataFrame, pk: str, scope: DataFrame | None = None) -> DataFrame:
    """Target rows with no source row."""
    return missing_rows(tgt, src, pk, scope)


def _row_marks(df: DataFrame, pk: Sequence[str], cols: Sequence[str], weight: int) -> DataFrame:
    # null flags keep (null, x) and (x, null) apart; two hashes make a chance match within one key negligible
    parts = [*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols]]
    return df.select(*pk, F.xxhash64(*parts).alias("__h1"), F.hash(*parts).alias("__h2"), F.lit(weight).alias("__w"))


def differing_keys(src: DataFrame, tgt: DataFrame, pk: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys whose rows are not the same on both sides.

    Only key and row hash move. Equal rows cancel in the aggregation, so what is
    left grows with the differences and not with the tables.
    """
    marks = _row_marks(src, pk, cols, 1).unionByName(_row_marks(tgt, pk, cols, -1))
    net = marks.groupBy(*pk, "__h1", "__h2").agg(F.sum("__w").alias("__net")).where("__net <> 0")
    return net.select(*pk).distinct()


def row_diff(src: DataFrame, tgt: DataFrame, pk: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """missing / extra / changed per key with the names of differing columns.

    The columns are compared only for keys that differ, and copies of a row count once.
    """
    keys = differing_keys(src, tgt, pk, cols)

    def side(df: DataFrame, p: str) -> DataFrame:
        rows = df.select(*pk, *cols).join(keys, list(pk), "left_semi").distinct()
        return _prefixed(rows.withColumn("seen", F.lit(True)), p, pk)

    names = F.array_compact(F.array(*[F.when(_differs("s_" + c, "t_" + c), F.lit(c)) for c in cols]))
    both = side(src, "s_").join(side(tgt, "t_"), list(pk), "full_outer").withColumn("changed", names)
    kind = F.when(F.col("t_seen").isNull(), "missing").when(F.col("s_seen").isNull(), "extra").otherwise("changed")
    return both.where(F.col("s_seen").isNull() | F.col("t_seen").isNull() | (F.size("changed") > 0)).select(
        *pk,
        kind.alias("kind"),
        F.when(kind == "changed", F.array_join("changed", ",")).otherwise("").alias("columns"),
    )


def result_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rows seen more often on one side, with the surplus of copies.

    Copies are counted with partial aggregation, so a row repeated a billion
    times is still one row in the shuffle. Expand ``copies`` for EXCEPT ALL form.
    """
    cols = src.columns
    tagged = src.select(*cols, F.lit(1).alias("__w")).unionByName(tgt.select(*cols, F.lit(-1).alias("__w")))
    net = tagged.groupBy(*cols).agg(F.sum("__w").alias("__net")).where("__net <> 0")
    return net.select(*cols, F.when(F.col("__net") > 0, "SOURCE").otherwise("TARGET").alias("side"), F.abs("__net").alias("copies"))


def match_rate(src: DataFrame, tgt: DataFrame, pk: str, cols: Sequence[str], pct: int = 100, gate: float = 99.9) -> DataFrame:
    """Share of (sampled) source rows whose digest is found under the same key."""
    s = sample_rows(src, pk, pct) if pct < 100 else src
    t = sample_rows(tgt, pk, pct) if pct < 100 else tgt
    s = s.select(F.col(pk).alias("k"), row_md5(s, cols).alias("sd"))
    t = t.select(F.col(pk).alias("k"), row_md5(t, cols).alias("sd")).distinct().withColumn("hit", F.lit(1))
    rate = F.round(F.try_divide(F.sum("hit") * F.lit(100.0), F.count(F.lit(1))), 4)
    return s.join(t, ["k", "sd"], "left").agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("rows_matched"),
        rate.alias("match_pct"),
        F.when(rate >= gate, "PASS").otherwise("FAIL").alias("status"),
    )


def breakdown(src: DataFrame, tgt: DataFrame, dims: Sequence[str], amount: str) -> DataFrame:
    """Every single dimension, and the total, side by side where they differ."""
    tagged = src.select(*dims, F.col(amount).alias("__a"), F.lit("s").alias("__side")).unionByName(
        tgt.select(*dims, F.col(amount).alias("__a"), F.lit("t").alias("__side"))
    )
    sets = [[F.col(d)] for d in dims] + [[]]
    s, t = F.col("__side") == "s", F.col("__side") == "t"
    out = tagged.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("grouping_level"),
        F.count_if(s).alias("source_rows"),
        F.count_if(t).alias("target_rows"),
        F.sum(F.when(s, F.col("__a"))).cast("string").alias("source_amount"),
        F.sum(F.when(t, F.col("__a"))).cast("string").alias("target_amount"),
    )
    return out.where(_differs("source_rows", "target_rows") | _differs("source_amount", "target_amount"))


def op_parity(src: DataFrame, tgt: DataFrame, ts: str, op: str, window: str) -> DataFrame:
    """Volume of each operation per window on both sides."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.date_trunc(window, ts).cast("timestamp_ntz").alias("window_start"), F.col(op).alias("op")).agg(
            F.count(F.lit(1)).alias(name)
        )

    zero = F.lit(0)
    out = side(src, "source_ops").join(side(tgt, "target_ops"), ["window_start", "op"], "full_outer")
    out = out.select(
        "window_start", "op", F.coalesce("source_ops", zero).alias("source_ops"), F.coalesce("target_ops", zero).alias("target_ops")
    )
    return out.withColumn("delta", F.col("target_ops") - F.col("source_ops"))


def compare_colocated(src: DataFrame, tgt: DataFrame, pk: str, table: str, cols: Sequence[str]) -> DataFrame:
    """``compare_buckets`` of two tables written by ``writers.write_colocated``: rows stay where they are.

    Both sides are bucketed by ``bucket_id``, so neither the fingerprints nor the join shuffle.
    """
    sides = [bucket_sums(d, F.col("bucket_id"), pk, cols) for d in (src, tgt)]
    return compare_buckets(*sides, keys=["bucket_id"]).select(F.lit(table).alias("table_name"), "*")


def range_fingerprint(df: DataFrame, by: Column, cols: Sequence[str]) -> DataFrame:
    """Count and hash sum per key range, time window or any other slice (Q03)."""
    from evenkeel.functions.canon import digest_number, wide_sum

    d = df.select(by.alias("slice"), digest_number(F.md5(F.concat_ws("|", *canon_columns(df, cols)))).alias("__h"))
    return d.groupBy("slice").agg(F.count(F.lit(1)).alias("row_count"), wide_sum(F.col("__h")).cast("string").alias("hash_sum"))


def localise(src: DataFrame, tgt: DataFrame, by, cols: Sequence[str]) -> DataFrame:
    """Slices that differ; ``by(df)`` gives the slicing column of a side (Q03)."""
    s = _prefixed(range_fingerprint(src, by(src), cols), "source_", ["slice"])
    t = _prefixed(range_fingerprint(tgt, by(tgt), cols), "target_", ["slice"])
    zero = F.lit(0)
    out = s.join(t, "slice", "full_outer").where(_differs("source_row_count", "target_row_count") | _differs("source_hash_sum", "target_hash_sum"))
    kind = F.when(_differs("source_row_count", "target_row_count"), "COUNT").otherwise("HASH")
    return out.select(
        "slice",
        kind.alias("difference"),
        F.coalesce("source_row_count", zero).alias("source_rows"),
        F.coalesce("target_row_count", zero).alias("target_rows"),
    )


def adjacent_check(before: DataFrame, after: DataFrame, repaired: DataFrame, cols: Sequence[str], by) -> DataFrame:
    """Neighbours of repaired ranges must be as they were before the repair (Q05).

    ``repaired`` has an integer column ``slice``. Slices form a sequence, so the
    neighbours are slice - 1 and slice + 1 unless those were repaired too.
    """
    near = repaired.select(F.explode(F.array(F.col("slice") - 1, F.col("slice") + 1)).alias("slice")).distinct()
    near = near.join(repaired.select("slice").distinct(), "slice", "left_anti")
    b = _prefixed(range_fingerprint(before, by(before), cols), "before_", ["slice"])
    a = _prefixed(range_fingerprint(after, by(after), cols), "after_", ["slice"])
    both = b.join(a, "slice", "full_outer")
    same = ~(_differs("before_row_count", "after_row_count") | _differs("before_hash_sum", "after_hash_sum"))
    return near.join(both, "slice").select("slice", F.when(same, "UNCHANGED").otherwise("CHANGED").alias("status"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, with partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
