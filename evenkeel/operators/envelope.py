"""Changes of several tables in one feed.

A line is ``{"operation", "table", "scn", "timestamp", "pk": {...}, "data": {...}}``.
Tables differ in their columns, so ``pk`` and ``data`` are variants until a change
has reached its table's own types.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.operators.replay import Policy, annotate, fold, stop_on_conflict
from evenkeel.session import scratch_path

OPERATIONS = {"INSERT": "I", "UPDATE": "U", "DELETE": "D"}
REJECTED, ROUTED = "rejected", "table "


@dataclass(frozen=True)
class Target:
    """A table that the feed changes: its rows, key and policy."""

    rows: DataFrame
    pk: tuple[str, ...]
    policy: Policy = field(default_factory=Policy)

    @property
    def fields(self) -> list[T.StructField]:
        return list(self.rows.schema.fields)


@dataclass(frozen=True)
class Replayed:
    """New rows of each table, rejected lines with their reason, and how many changes went which way."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    counts: DataFrame


def parse(lines: DataFrame, value: str = "value", place: str | None = None) -> DataFrame:
    """Envelope fields of each line; ``place`` orders changes that share an scn (a column of ``lines``)."""
    v = F.try_parse_json(value)
    out = lines.select(
        F.col(value).alias("raw"),
        (F.lit(0).cast("long") if place is None else F.col(place).cast("long")).alias("place"),
        v.alias("v"),
    )
    return out.select(
        "raw",
        "place",
        F.col("v").isNotNull().alias("is_json"),
        F.try_variant_get("v", "$.operation", "string").alias("operation"),
        F.try_variant_get("v", "$.table", "string").alias("table"),
        F.try_variant_get("v", "$.scn", "long").alias("scn"),
        F.try_variant_get("v", "$.timestamp", "timestamp").alias("timestamp"),
        F.try_variant_get("v", "$.pk", "variant").alias("pk"),
        F.try_variant_get("v", "$.data", "variant").alias("data"),
    )


def _letter() -> Column:
    names = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    return F.try_element_at(names, F.upper("operation"))


def route(parsed: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """Parsed changes with their operation's letter and the reason why a change can't be applied, if any."""
    known = F.coalesce(F.col("table").isin(*targets), F.lit(False))
    reason = (
        F.when(~F.col("is_json"), "bad json")
        .when(_letter().isNull(), "unknown operation")
        .when(~known, "unknown table")
        .when(F.col("scn").isNull(), "no position")
    )
    return parsed.withColumn("op", _letter()).withColumn("reason", reason)


def _path(name: str) -> str:
    return f"$['{name}']" if '"' in name else f'$["{name}"]'


def typed(routed: DataFrame, target: Target) -> DataFrame:
    """Changes of one table in its own types, with the carried columns and a reason for those that don't fit.

    An insert's key stands in its data (or, without any, in ``pk``), that of an update
    or delete in ``pk``. A field that is absent isn't carried, a null is a value, fields
    the table doesn't have are passed over. A value that its column's type can't hold
    rejects the change.
    """
    key = F.when(F.col("op") == "I", F.coalesce("data", "pk")).otherwise(F.col("pk"))
    out = routed.withColumn("__key", key)
    columns, carried, bad = [], [], []
    for f in target.fields:
        is_key = f.name in target.pk
        home = "__key" if is_key else "data"
        column = F.try_variant_get(home, _path(f.name), f.dataType.simpleString())
        given = F.try_variant_get(home, _path(f.name), "variant")
        is_null = given.isNull() | F.is_variant_null(given)
        if is_key:
            bad.append(F.when(is_null, f"no key: {f.name}").when(column.isNull(), f"bad value: {f.name}"))
        else:
            bad.append(F.when((F.col("op") != "D") & ~is_null & column.isNull(), f"bad value: {f.name}"))
            carried.append(F.when(given.isNotNull(), f.name))
        columns.append((F.when(F.col("op") != "D", column) if not is_key else column).alias(f.name))
    return out.select(
        *[F.col(c).alias("__" + c) for c in ("raw", "scn", "place", "op")],
        *columns,
        F.array_compact(F.array(*carried)).alias("__carried"),
        F.coalesce("reason", *bad).alias("__reason"),
    )


def position() -> Column:
    """Commit order as one binary that sorts like scn, place and, for what shares both, the line's digest."""
    parts = [F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(2**63)))), 16, "0") for c in ("__scn", "__place")]
    return F.unhex(F.concat(*parts, F.md5("__raw")))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table as files in the shared folder, for steps that read it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replay_envelopes(lines: DataFrame, targets: Mapping[str, Target], value: str = "value", place: str | None = None) -> Replayed:
    """Apply one feed to all its targets in commit order, each table with its own columns and policy.

    The feed is read once and laid out by table; each table's changes are then brought
    into its types once, and written without repeats, so all later steps read them narrow
    and parsed. Rejected changes don't touch their table. Equal lines are one change
    that was delivered again. Every table's ABORT policy is checked before anything is
    returned.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "envelopes")
    routed = route(parse(lines, value, place), targets)
    part = F.when(F.col("reason").isNull(), F.concat(F.lit(ROUTED), F.col("table"))).otherwise(REJECTED)
    routed.withColumn("part", part).write.partitionBy("part").parquet(path)
    laid = spark.read.schema(T.StructType([*routed.schema.fields, T.StructField("part", T.StringType())])).parquet(path)

    tables, rejected, counts = {}, [laid.where(F.col("part") == REJECTED).select("table", "scn", "raw", "reason")], []
    for name, target in targets.items():
        pk = list(target.pk)
        cols = [f.name for f in target.fields if f.name not in pk]
        changes = typed(laid.where(F.col("part") == ROUTED + name), target)
        is_fit = F.col("__reason").isNull()
        kept = changes.select("__scn", F.when(~is_fit, F.col("__raw")).alias("__raw"), "__reason", *pk, *cols, "__carried", F.when(is_fit, position()).alias("__pos"), "__op")
        changes = _written(kept, "typed-changes")
        unfit = changes.where(~is_fit)
        rejected.append(unfit.select(F.lit(name).alias("table"), F.col("__scn").alias("scn"), F.col("__raw").alias("raw"), F.col("__reason").alias("reason")))
        fit = changes.where(is_fit).select(*pk, *cols, "__carried", "__pos", "__op")
        once = _written(fit.dropDuplicates([*pk, "__pos"]), "changes-once")
        stream = annotate(target.rows, once, pk, "__pos", "__op", target.policy)
        stop_on_conflict(stream, pk, "__pos", target.policy)
        untouched = target.rows.join(once.select(*pk).distinct(), pk, "left_anti")
        tables[name] = untouched.select(*pk, *cols).unionByName(fold(stream, pk, cols, "__pos", "__op", "__carried"))
        of_table = stream.where("outcome <> 'base'").groupBy("outcome").agg(F.count(F.lit(1)).alias("changes"))
        counts.append(of_table.select(F.lit(name).alias("table"), "outcome", "changes"))
    dead = reduce(DataFrame.unionByName, rejected)
    counts.append(dead.groupBy("table").agg(F.count(F.lit(1)).alias("changes")).select("table", F.lit("rejected").alias("outcome"), "changes"))
    return Replayed(tables, dead, reduce(DataFrame.unionByName, counts))
