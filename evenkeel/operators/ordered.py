"""Streaks, deltas, gaps, islands and trailing rates.

Every ordered calculation runs in segments (see ``functions.segments``), so a
key with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evenkeel.functions.segments import Layout, exact_quantiles, find_layout, lagged, running, streaks


def pct_of_total(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Share of the grand total; the total is one aggregated row, not a global window."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.try_divide(F.col(value) * F.lit(100.0), total).cast("decimal(8,2)").cast("double"))


def heartbeat(df: DataFrame, key: str, order: Sequence[str], ok: str, threshold: int = 3, prior: DataFrame | None = None) -> DataFrame:
    """Consecutive failures up to each check, and whether the alarm is on.

    ``prior`` (key, streak) carries the streaks of an earlier batch: each enters
    as that many failures ahead of its key.
    """
    rows = df.withColumn("__fail", F.when(F.col(ok), 0).otherwise(1).cast("long")).withColumn("__base", F.lit(False))
    if prior is not None:
        base = prior.select(key, F.col("streak").cast("long").alias("__fail")).withColumn("__base", F.lit(True))
        rows = rows.unionByName(base, allowMissingColumns=True)
    layout = find_layout(df, [key], order[0])  # from the plain input, not from the union
    out = streaks(rows, [key], order, F.col("__fail"), F.coalesce(F.col(ok), F.lit(False)), "streak", layout)
    return out.where("NOT __base").drop("__fail", "__base").withColumn("alarm", F.col("streak") >= threshold)


def snapshot_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, layout: Layout | None = None) -> DataFrame:
    """Growth of a cumulative counter; a drop means a restart, so the value itself counts."""
    prev = lagged(df, keys, order, {"__prev": F.col(value)}, layout)
    delta = F.when(F.col("__prev").isNull(), F.lit(None)).when(F.col(value) < F.col("__prev"), F.col(value)).otherwise(F.col(value) - F.col("__prev"))
    return prev.withColumn("delta", delta).drop("__prev")


def sequence_gaps(df: DataFrame, seq: str, keys: Sequence[str] = ()) -> DataFrame:
    """Missing stretches in a numbered sequence."""
    numbers = df.select(*keys, seq).distinct()
    prev = lagged(numbers, list(keys), [seq], {"__prev": F.col(seq)}, find_layout(df, list(keys), seq))
    return prev.where(F.col(seq) - F.col("__prev") > 1).select(
        *keys,
        (F.col("__prev") + 1).alias("gap_start"),
        (F.col(seq) - 1).alias("gap_end"),
        (F.col(seq) - F.col("__prev") - 1).alias("missing"),
    )


def sustained(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, min_seconds: int) -> DataFrame:
    """Stretches in which the condition held without a break for ``min_seconds``.

    The number of breaks so far names the stretch; stretches are then ordinary groups.
    """
    ts = order[0]
    marked = df.withColumn("__c", F.coalesce(condition, F.lit(False)))
    named = running(marked, keys, order, {"__breaks": ("sum", F.when(F.col("__c"), 0).otherwise(1))})
    spans = named.where("__c").groupBy(*keys, "__breaks").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("samples")
    )
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6)
    return spans.withColumn("duration_s", seconds).where(F.col("duration_s") >= min_seconds).drop("__breaks")


def trailing_sum(df: DataFrame, keys: Sequence[str], ts: str, value: Column, seconds: int, out: str, plain: DataFrame | None = None) -> DataFrame:
    """Sum over [ts - seconds, ts] per key; rows without a time sum up among themselves.

    Each row adds its value when it comes, takes it back just after the window's length
    and asks for the sum once all values of its instant have come. The running sum over
    these steps reads the input once and costs the same however many rows a window holds.
    Fractions are summed as decimals, so taking back leaves no rest. ``plain`` may be a
    cheaper table with the same keys and times, for the look at hot keys.
    """
    kind = df.select(value.alias("v")).schema["v"].dataType
    fraction = isinstance(kind, (T.DoubleType, T.FloatType))
    exact = value.cast("decimal(28,9)") if fraction else value
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    asking = df.select(F.struct("*").alias("__row")).schema["__row"].dataType.simpleString()

    def step(at: Column, turn: int, change: Column, asked: Column) -> Column:
        return F.struct(at.alias("__us"), F.lit(turn).alias("__turn"), change.alias("__step"), asked.alias("__row"))

    nobody = F.lit(None).cast(asking)
    gone = F.when(us.isNotNull(), step(us + seconds * 1000000 + 1, 0, -exact, nobody))
    each = F.array_compact(F.array(step(us, 0, exact, nobody), gone, step(us, 1, F.lit(None).cast(df.select(exact.alias("v")).schema["v"].dataType), F.struct("*"))))
    steps = df.select(*keys, us.isNotNull().alias("__timed"), F.explode(each).alias("__e")).select(*keys, "__timed", "__e.*")
    looked = (df if plain is None else plain).select(*keys, us.isNotNull().alias("__timed"), us.alias("__us"))
    layout = find_layout(looked, [*keys, "__timed"], "__us")
    summed = running(steps, [*keys, "__timed"], ["__us", "__turn"], {out: ("sum", F.col("__step"))}, layout=layout).where("__turn = 1")
    return summed.select("__row.*", (F.col(out).cast(kind) if fraction else F.col(out)).alias(out))


def rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, seconds: int = 300, layout: Layout | None = None) -> DataFrame:
    """Increase of a counter per second over the trailing window, restarts handled."""
    steps = snapshot_delta(df, keys, order, counter, layout)
    summed = trailing_sum(steps, keys, order[0], F.coalesce("delta", F.lit(0)), seconds, "__inc", df)
    return summed.withColumn("rate", F.col("__inc").cast("double") / seconds).drop("__inc", "delta")


def wow_regression(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), pct: float = 20.0, p: float = 0.99) -> DataFrame:
    """Weekly p99 against the week before (W09). One row per key and week, so the lag is small."""
    weekly = exact_quantiles(df.withColumn("week", F.date_trunc("week", ts).cast("timestamp_ntz")), [*keys, "week"], value, {"p": p})
    w = Window.partitionBy(*keys).orderBy("week")
    prev = F.lag("p").over(w)
    change = F.round(F.try_divide((F.col("p") - prev) * 100.0, prev), 4)
    return weekly.select(*keys, "week", F.round("p", 6).alias("p99"), change.alias("change_pct"), F.coalesce(change > pct, F.lit(False)).alias("regressed"))


def size_drop(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, frac: float = 0.5) -> DataFrame:
    """Rows below ``frac`` of the average of all earlier rows of their key."""
    money = F.col(value).cast("decimal(18,2)")
    hist = running(df, keys, order, {"__s": ("sum", money), "__n": ("sum", F.lit(1))}, exclusive=True)
    avg = F.col("__s").cast("double") / F.col("__n")
    return hist.withColumn("avg_before", avg).where(F.col(value) < F.col("avg_before") * frac).drop("__s", "__n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """rank() <= n per group; Spark prunes each task to the group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= n)
