"""Blockers and victims."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evenkeel.session import cut_lineage


def blocking_pairs(locks: DataFrame, resource: Sequence[str], pid: str = "pid") -> DataFrame:
    """Waiter and holder of the same resource, null-safe on every part of it.

    Holders are made distinct per resource first. A resource with many waiters is
    a skewed join key that the adaptive join splits; nothing is aggregated after it.
    """
    waiting = locks.where(~F.col("granted")).select(*[F.col(c).alias("w_" + c) for c in resource], F.col(pid).alias("blocked_pid"), F.col("mode").alias("blocked_mode"))
    holding = locks.where(F.col("granted")).select(*resource, F.col(pid).alias("blocker_pid"), F.col("mode").alias("blocker_mode")).distinct()
    same = reduce(lambda a, b: a & b, [waiting["w_" + c].eqNullSafe(holding[c]) for c in resource])
    return waiting.distinct().join(holding, same & (F.col("blocked_pid") != F.col("blocker_pid"))).drop(*["w_" + c for c in resource])


def blocking_from_lists(activity: DataFrame, pid: str, blockers: str, info: Sequence[str]) -> DataFrame:
    """One row per blocked/blocker pair from arrays of blockers (J15); explode, then equi-join."""
    pairs = activity.select(F.col(pid).alias("blocked_pid"), *[F.col(c).alias("blocked_" + c) for c in info], F.explode(blockers).alias("blocker_pid"))
    other = activity.select(F.col(pid).alias("blocker_pid"), *[F.col(c).alias("blocker_" + c) for c in info])
    return pairs.join(other, "blocker_pid")


def blocking_tree(edges: DataFrame, keys: Sequence[str], blocked: str, blocker: str) -> DataFrame:
    """Head blockers of every blocked session, with the fewest waits to each.

    A session may have several blockers, so it has a row for each head blocker that it
    waits for, over whatever way. Each round lets every open session jump to the
    ancestors of its ancestors, so lengths double: chains of any length need
    log2(length) rounds, and equal pairs are joined into one after each. When the length
    exceeds the number of sessions, what is still open leads into a cycle. A session is
    deadlocked if it waits for itself, or if all its ways end in a cycle; without a head
    it has one row with nulls. Only open rows take part in a round.
    """
    k = list(keys)
    links = edges.select(*k, F.col(blocked).alias("session"), F.col(blocker).alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct()
    first = links.join(links.select(*k, F.col("session").alias("ancestor")).withColumn("__more", F.lit(True)), [*k, "ancestor"], "left")
    state = cut_lineage(first.select(*k, "session", "ancestor", "depth", F.coalesce("__more", F.lit(False)).alias("open")))
    most = links.groupBy(*k).agg(F.count_distinct("session").alias("n")).agg(F.max("n")).first()[0] or 0
    length, left = 1, not state.where("open").isEmpty()
    while left and length <= most:
        jump = state.select(*k, F.col("session").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("depth").alias("__d"), F.col("open").alias("__o"))
        moved = state.where("open").join(jump, [*k, "ancestor"]).select(
            *k, "session", F.col("__a").alias("ancestor"), (F.col("depth") + F.col("__d")).alias("depth"), F.col("__o").alias("open")
        )
        merged = state.where("NOT open").unionByName(moved).groupBy(*k, "session", "ancestor").agg(F.min("depth").alias("depth"), F.first("open").alias("open"))
        state = cut_lineage(merged)
        length, left = 2 * length, not state.where("open").isEmpty()
    heads = state.where("NOT open").select(*k, "session", F.col("ancestor").alias("head_blocker"), "depth")
    every = links.select(*k, "session").distinct()
    # without a head a session is deadlocked anyway; all on a cycle have the same heads, so whole cycles stay or go
    suspects = state.where("open").select(*k, "session").distinct().join(heads.select(*k, "session"), [*k, "session"], "left_semi")
    circular = on_cycle(links, suspects, k).withColumn("__circular", F.lit(True))
    joined = every.join(heads, [*k, "session"], "left").join(circular, [*k, "session"], "left")
    return joined.select(*k, "session", "head_blocker", "depth", (F.coalesce("__circular", F.lit(False)) | F.col("head_blocker").isNull()).alias("deadlocked"))


def on_cycle(links: DataFrame, suspects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Suspects that wait for themselves, over waits among suspects.

    Only sessions that lead both into a cycle and to a head are suspects, so the set of
    all pairs that is grown here until it stays the same is that of such cycles alone.
    """
    k = list(keys)
    inner = links.select(*k, "session", "ancestor").join(suspects, [*k, "session"], "left_semi")
    inner = inner.join(suspects.withColumnRenamed("session", "ancestor"), [*k, "ancestor"], "left_semi").select(*k, "session", "ancestor").distinct()
    pairs, before = cut_lineage(inner), -1
    while (now := pairs.count()) != before:
        before = now
        onward = pairs.select(*k, F.col("session").alias("ancestor"), F.col("ancestor").alias("__next"))
        further = pairs.join(onward, [*k, "ancestor"]).select(*k, "session", F.col("__next").alias("ancestor"))
        pairs = cut_lineage(pairs.unionByName(further).distinct())
    return pairs.where("session = ancestor").select(*k, "session").distinct()


def head_blockers(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Victims and longest chain of each head blocker."""
    return tree.where(F.col("head_blocker").isNotNull()).groupBy(*keys, "head_blocker").agg(F.count(F.lit(1)).alias("victims"), F.max("depth").alias("max_depth"))


def blocker_action(df: DataFrame, kind: str, seconds: str) -> DataFrame:
    """What to do with a blocker by its kind and age."""
    k, s = F.col(kind), F.col(seconds)
    action = (
        F.when(k == "idle_transaction", "KILL")
        .when((k == "slow_query") & (s < 120), "WAIT_AND_RETRY")
        .when(k == "slow_query", "KILL_IF_NOT_CRITICAL")
        .when((k == "ddl") & (s < 300), "WAIT")
        .when(k == "ddl", "EVALUATE_CANCEL")
        .otherwise("INVESTIGATE")
    )
    return df.withColumn("decision", action)


def blocked_scope(df: DataFrame, count: str) -> DataFrame:
    """Reading of the number of blocked sessions."""
    c = F.col(count)
    return df.withColumn("scope", F.when(c >= 10, "POOL_EXHAUSTION").when(c >= 1, "DATA_LOCK").otherwise("CLEAR"))
