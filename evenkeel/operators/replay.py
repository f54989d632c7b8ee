"""Change-data-capture in batch form.

Change rows are flat: key columns, an integer position, an operation I/U/D and
the payload columns. A change may carry only some payload columns; then an array
column names the ones it carries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions.positions import decode_op, lag_minutes
from evenkeel.functions.segments import find_layout, lagged, running
from evenkeel.session import cut_lineage

BASE_POSITION = -9223372036854775808


def before_all(kind: T.DataType) -> Column:
    """A position ahead of every other of its type."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    return F.lit(BASE_POSITION).cast(kind)


class ReplayConflict(RuntimeError):
    """A change broke an ABORT policy."""


@dataclass(frozen=True)
class Policy:
    """on_conflict: SKIP, UPSERT or ABORT; on_missing: SKIP or ABORT (C11)."""

    on_conflict: str = "SKIP"
    on_missing: str = "SKIP"


def changes_between(df: DataFrame, seq: str, low, high, tables: Sequence[str] | None = None, table: str = "table") -> DataFrame:
    """Known operations in (low, high], of the listed tables."""
    out = df.where((F.col(seq) > low) & (F.col(seq) <= high) & F.col("op").isin("I", "U", "D"))
    return out if tables is None else out.where(F.col(table).isin(*tables))


def net_changes(changes: DataFrame, pk: Sequence[str], seq: str) -> DataFrame:
    """Last change of each key; combines before the shuffle, so hot keys are cheap."""
    rest = [c for c in changes.columns if c not in pk]
    return changes.groupBy(*pk).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*pk, "r.*")


def _carried(name: str, carried: str | None) -> Column:
    return F.lit(True) if carried is None else F.array_contains(F.col(carried), name)


def annotate(target: DataFrame, changes: DataFrame, pk: Sequence[str], seq: str = "seq", op: str = "op", policy: Policy = Policy()) -> DataFrame:
    """Changes and the touched target rows in one ordered stream, with each change's outcome.

    A target row enters as a base event ahead of every change of its key. Whether
    the row exists before a change is decided by the last base/insert/delete before
    it, a running maximum computed in segments, so one key may have any number of
    changes.
    """
    cols = [c for c in target.columns if c not in pk]
    touched = target.join(changes.select(*pk).distinct(), list(pk), "left_semi")
    base = touched.select(*pk, *cols, before_all(changes.schema[seq].dataType).alias(seq), F.lit("B").alias(op))
    stream = changes.unionByName(base, allowMissingColumns=True)
    o = F.col(op)
    event = F.when(o.isin("B", "I", "D"), F.struct(F.col(seq).alias("p"), (o != "D").alias("alive")))
    seen = running(stream, pk, [seq], {"__before": ("max", event)}, exclusive=True, layout=find_layout(changes, pk, seq))
    exists = F.coalesce(F.col("__before")["alive"], F.lit(False))
    seen = seen.withColumn("__exists", exists).drop("__before")
    outcome = (
        F.when(o == "B", "base")
        .when((o == "I") & F.col("__exists"), {"SKIP": "conflict_skipped", "UPSERT": "upserted", "ABORT": "conflict_abort"}[policy.on_conflict])
        .when(o == "I", "inserted")
        .when(o.isin("U", "D") & ~F.col("__exists"), {"SKIP": "missing_skipped", "ABORT": "missing_abort"}[policy.on_missing])
        .when(o == "U", "updated")
        .when(o == "D", "deleted")
        .otherwise("unknown_op")
    )
    return seen.withColumn("outcome", outcome)


def fold(
    annotated: DataFrame, pk: Sequence[str], cols: Sequence[str], seq: str = "seq", op: str = "op", carried: str | None = None, keep_dead: bool = False
) -> DataFrame:
    """Final rows of the keys in an annotated stream; dead keys too, marked, if asked.

    The last creating event sets every column, so the newest effective value of
    each column always belongs to the row's current life. All aggregates combine
    before the shuffle.
    """
    creating = F.col("outcome").isin("base", "inserted")
    aggs = []
    for c in cols:
        value = F.when(creating & ~_carried(c, carried) & (F.col("outcome") != "base"), F.struct(F.lit(None).cast(annotated.schema[c].dataType).alias("v"))).otherwise(
            F.struct(F.col(c).alias("v"))
        )
        sets = creating | (F.col("outcome").isin("updated", "upserted") & _carried(c, carried))
        aggs.append(F.max_by(F.when(sets, value), F.when(sets, F.col(seq))).alias(c))
    alive = F.max_by(F.when(F.col(op).isin("B", "I", "D"), F.col(op) != "D"), F.when(F.col(op).isin("B", "I", "D"), F.col(seq)))
    final = annotated.groupBy(*pk).agg(F.coalesce(alive, F.lit(False)).alias("alive"), *aggs)
    final = final.select(*pk, "alive", *[F.col(c)["v"].alias(c) for c in cols])
    return final if keep_dead else final.where("alive").drop("alive")


def stop_on_conflict(annotated: DataFrame, pk: Sequence[str], seq: str, policy: Policy) -> None:
    """Raise if an ABORT policy is broken (C11)."""
    if "ABORT" in (policy.on_conflict, policy.on_missing):
        broken = annotated.where(F.col("outcome").isin("conflict_abort", "missing_abort")).select(*pk, seq, "outcome").limit(1).collect()
        if broken:
            raise ReplayConflict(str(broken[0].asDict()))


def replay(
    target: DataFrame,
    changes: DataFrame,
    pk: Sequence[str],
    seq: str = "seq",
    op: str = "op",
    policy: Policy = Policy(),
    carried: str | None = None,
) -> DataFrame:
    """Target after the changes, applied in order.

    Untouched target rows bypass the fold. An ABORT policy checks the outcomes
    first and raises, before anything is written.
    """
    cols = [c for c in target.columns if c not in pk]
    stream = annotate(target, changes, pk, seq, op, policy)
    stop_on_conflict(stream, pk, seq, policy)
    untouched = target.join(changes.select(*pk).distinct(), list(pk), "left_anti")
    return untouched.select(*pk, *cols).unionByName(fold(stream, pk, cols, seq, op, carried))


def replay_outcomes(target: DataFrame, changes: DataFrame, pk: Sequence[str], seq: str = "seq", op: str = "op", policy: Policy = Policy()) -> DataFrame:
    """How many changes were applied, skipped or failed."""
    return annotate(target, changes, pk, seq, op, policy).where("outcome <> 'base'").groupBy("outcome").agg(F.count(F.lit(1)).alias("changes"))


def replay_upsert(target: DataFrame, changes: DataFrame, pk: Sequence[str], seq: str = "seq", carried: str | None = None) -> DataFrame:
    """Every change upserts its columns whatever its operation; nothing is deleted."""
    cols = [c for c in target.columns if c not in pk]
    aggs = []
    for c in cols:
        sets = _carried(c, carried)
        aggs.append(F.max_by(F.when(sets, F.struct(F.col(c).alias("v"))), F.when(sets, F.col(seq))).alias("__n_" + c))
    new = changes.groupBy(*pk).agg(*aggs)
    touched = target.join(new.select(*pk), list(pk), "left_semi")
    untouched = target.join(new.select(*pk), list(pk), "left_anti")
    both = touched.join(new, list(pk), "full_outer")
    out = both.select(*pk, *[F.when(F.col("__n_" + c).isNotNull(), F.col("__n_" + c)["v"]).otherwise(F.col(c)).alias(c) for c in cols])
    return untouched.select(*pk, *cols).unionByName(out)


def replay_coded(target: DataFrame, changes: DataFrame, pk: str, seq: str = "seq", code: str = "code", policy: Policy = Policy("UPSERT"), carried: str | None = None) -> DataFrame:
    """Coded changes: before images, unknown codes, null keys and key-only updates drop out.

    ``seq`` is a number, or the binary position of ``positions.composite``, whose parts
    (log position, place in its transaction, code) then decide the order one by one.
    """
    names = {"DELETE": "D", "INSERT": "I", "UPDATE_AFTER": "U"}
    letter = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    c = changes.withColumn("op", F.try_element_at(letter, decode_op(code))).where(F.col("op").isNotNull() & F.col(pk).isNotNull())
    if carried is not None:
        c = c.where((F.col("op") != "U") | (F.size(F.array_remove(carried, pk)) > 0))
    return replay(target, c.drop(code), [pk], seq, "op", policy, carried)


def checkpoint_of(changes: DataFrame, table: str, seq: str, ts: str) -> DataFrame:
    """Per table: last position, last time, rows applied."""
    return changes.groupBy(table).agg(
        F.max(seq).alias("last_seq"), F.max(ts).alias("last_timestamp"), F.count(F.lit(1)).alias("rows_applied")
    )


def merge_checkpoint(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Advance a checkpoint; positions never go back, counts add up."""
    return old.unionByName(new).groupBy(table).agg(
        F.max("last_seq").alias("last_seq"), F.max("last_timestamp").alias("last_timestamp"), F.sum("rows_applied").alias("rows_applied")
    )


def skip_applied(changes: DataFrame, checkpoint: DataFrame, table: str, seq: str, restart: bool = False, identity: Sequence[str] | None = None) -> DataFrame:
    """Changes beyond the checkpoint of their table, each change once.

    Changes of one transaction may share a position: only rows equal in ``identity``
    (all columns if not given) are repeats. ``seq`` may be a struct of several numbers,
    such as a log position and a place within it. The feed must be in order of the table;
    for one that is only in order of each key see ``split_late``.
    """
    once = changes.dropDuplicates(list(identity) if identity else changes.columns)
    if restart:
        return once
    # one row for each table of the feed, so the marks are one value; a join on a feed of one table would lose its key
    marks = checkpoint.where(F.col(table).isNotNull()).groupBy(table).agg(F.max("last_seq").alias("last"))
    last = F.try_element_at(marks.agg(F.map_from_entries(F.collect_list(F.struct(table, "last")))).scalar(), F.col(table))
    return once.where(last.isNull() | (F.col(seq) > last))


def split_late(changes: DataFrame, positions: DataFrame, pk: Sequence[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Changes beyond the last position of their own key, and those that come too late.

    ``positions`` has ``last_seq`` per key. Other keys' positions say nothing about a
    change, so feeds whose files interleave lose none.
    """
    joined = changes.join(positions.select(*pk, F.col("last_seq").alias("__last")), list(pk), "left")
    fresh = F.col("__last").isNull() | (F.col(seq) > F.col("__last"))
    return joined.where(fresh).drop("__last"), joined.where(~fresh).drop("__last")


def order_tables(tables: DataFrame, name: str, exclude: Sequence[str], priority: Sequence[str], depends: dict[str, int] | None = None) -> DataFrame:
    """Tables to replay with their place: priority list first, then dependency level, then name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name)), F.lit(0))
    rank = F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))
    level = F.lit(0)
    for t, n in (depends or {}).items():
        level = F.when(F.col(name) == t, n).otherwise(level)
    return tables.where(~F.col(name).isin(*exclude)).withColumn("priority_rank", rank.cast("int")).withColumn("dependency_level", level)


def dependency_levels(tables: DataFrame, links: DataFrame, name: str, parent: str) -> DataFrame:
    """``name, dependency_level, in_order``: each table's place in an order that loads parents first.

    ``links`` has a row (table, parent) for each foreign key; a key of a table to itself
    says nothing. Level 0 refers to nobody, every other table is one above its highest
    parent. Each round places the tables whose parents are all placed, so the rounds are
    as many as levels. Tables on a cycle, or behind one, have no level and ``in_order``
    is false: their keys must be deferred.
    """
    once = links.where(F.col(name) != F.col(parent)).select(name, parent).distinct()
    known = once.select(name).union(once.select(parent)).union(tables.select(name)).distinct()
    placed, open_, level = None, cut_lineage(known), 0
    left = cut_lineage(once)
    while True:
        ready = cut_lineage(open_.join(left.select(name).distinct(), name, "left_anti").withColumn("dependency_level", F.lit(level)))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        open_ = cut_lineage(open_.join(ready.select(name), name, "left_anti"))
        left = cut_lineage(left.join(ready.select(F.col(name).alias(parent)), parent, "left_anti"))
        level += 1
    stuck = open_.withColumn("dependency_level", F.lit(None).cast("int"))
    every = stuck if placed is None else placed.unionByName(stuck)
    return every.select(name, "dependency_level", F.col("dependency_level").isNotNull().alias("in_order"))


def position_intervals(changes: DataFrame, table: str, seq: str) -> DataFrame:
    """``table, low, high``: the stretches of positions that have come, of each table (C14)."""
    return merge_intervals(changes.select(table, F.col(seq).alias("low"), F.col(seq).alias("high")), table)


def merge_intervals(intervals: DataFrame, table: str) -> DataFrame:
    """Intervals of several batches as few as possible: those that meet, overlap or repeat become one (C14).

    An interval begins a new stretch if it lies beyond all that started before it; the
    number of such beginnings names the stretch. Both are running values in segments, so
    one table may have any number of intervals.
    """
    once = cut_lineage(intervals.select(table, "low", "high").where("low IS NOT NULL").groupBy(table, "low").agg(F.max("high").alias("high")))
    layout = find_layout(once, [table], "low")
    seen = running(once, [table], ["low"], {"__reach": ("max", F.col("high"))}, exclusive=True, layout=layout)
    begins = F.when(F.col("__reach").isNull() | (F.col("low") > F.col("__reach") + 1), 1).otherwise(0)
    named = running(seen.withColumn("__begins", begins), [table], ["low"], {"__stretch": ("sum", F.col("__begins"))}, layout=layout)
    return cut_lineage(named.groupBy(table, "__stretch").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("__stretch"))


def missing_positions(intervals: DataFrame, table: str) -> DataFrame:
    """``table, first_missing, last_missing, missing``: holes between merged intervals (C14).

    A checkpoint that jumped ahead shows here, until late files fill the hole.
    """
    prev = lagged(intervals, [table], ["low"], {"__prev": F.col("high")})
    holes = prev.where(F.col("low") > F.col("__prev") + 1)
    return holes.select(table, (F.col("__prev") + 1).alias("first_missing"), (F.col("low") - 1).alias("last_missing"), (F.col("low") - F.col("__prev") - 1).alias("missing"))


def cdc_health(checkpoint: DataFrame, as_of: DataFrame, target_min: float = 5, alert_min: float = 15, error_alert: float = 0.01) -> DataFrame:
    """Lag and error-rate state per table."""
    lag = lag_minutes(F.col("last_timestamp"), F.col("as_of"))
    rate = F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("rows_applied")), F.lit(0.0))
    out = checkpoint.withColumn("as_of", as_of.scalar()).withColumn("lag_minutes", lag).withColumn("error_rate", rate).drop("as_of")
    return out.withColumn("lag_state", F.when(F.col("lag_minutes") > alert_min, "ALERT").when(F.col("lag_minutes") > target_min, "WARN").otherwise("OK")).withColumn(
        "error_state", F.when(F.col("error_rate") > error_alert, "ALERT").otherwise("OK")
    )


def late_changes(changes: DataFrame, pk: Sequence[str], seq: str, ts: str, arrival: str, delay_seconds: int) -> DataFrame:
    """Marks changes behind the time already seen, and repeats of a change (C14).

    Both marks are running values over arrival order, computed in segments: one
    change may be repeated any number of times.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = running(changes, [], [arrival], {"__max_ts": ("max", us)}, exclusive=True)
    seen = running(seen, [*pk, seq], [arrival], {"__copies": ("sum", F.lit(1))}, exclusive=True, layout=find_layout(changes, [*pk, seq], arrival))
    late = F.coalesce(us < F.col("__max_ts") - F.lit(delay_seconds * 1000000), F.lit(False))
    return seen.withColumn("late", late).withColumn("duplicate", F.coalesce(F.col("__copies") > 0, F.lit(False))).drop("__max_ts", "__copies")


def shadow_sync(source: DataFrame, changes: DataFrame, new_columns: dict[str, Column], pk: str, seq: str = "seq") -> DataFrame:
    """Copy into the new schema, then apply the changes to the copy.

    ``new_columns`` maps each new column to its expression over source columns.
    Switch only after ``compare_summaries`` of both is clean.
    """
    copy = source.select(pk, *[e.alias(n) for n, e in new_columns.items()])
    moved = changes.select(pk, seq, "op", *[e.alias(n) for n, e in new_columns.items()])
    return replay(copy, moved, [pk], seq, "op", Policy("UPSERT"))
