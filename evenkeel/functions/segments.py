"""Ordered per-key calculations that do not put a hot key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and a
key may hold a third of all rows. Before an ordered calculation a look at the data
finds the keys that hold more than a fair share. Without any, a plain window is the
best plan and is used. Otherwise the order column is cut into segments of about
equal depth: windows run per (key, segment), other keys stay in segment 0, and
what a segment needs from earlier ones arrives through a small table with one row
per (key, segment). The big side is shuffled once, on (key, segment); windows,
carry aggregation and the join back all use that partitioning.

Hot keys and borders are found once, reach the driver as short lists and enter the
plan as literals, so every stage (and every retry) sees the same layout. Results do
not depend on the layout.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SEGMENT = "__segment"
GROUP = "__group"
LEVELS = 3
MERGE_GROUPS = 256
SAMPLE_ROWS = 2_000_000
MIN_HOT_ROWS = 50
_FNS = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Borders:
    """fan**LEVELS - 1 rising numbers that cut the order into fan**LEVELS segments."""

    fan: int
    values: tuple[int, ...]


LEADING_DIGITS = 15  # hexadecimal digits of a text's beginning that fit a long


def order_number(df: DataFrame, name: str) -> Column:
    """The order column as a long that never falls where the column rises."""
    return _order_number(F.col(f"`{name}`"), df.schema[name].dataType)


def _order_number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(dtype, T.IntegralType):
        return col.cast("long")
    if isinstance(dtype, T.NumericType):
        return _whole(col.cast("double"))
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        digits = F.hex(col if isinstance(dtype, T.BinaryType) else F.encode(col, "utf-8"))
        return F.conv(F.rpad(F.substring(digits, 1, LEADING_DIGITS), LEADING_DIGITS, "0"), 16, 10).cast("long")
    if isinstance(dtype, T.StructType):  # structs sort by their first field first
        return _order_number(col.getField(dtype.fields[0].name), dtype.fields[0].dataType)
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("long")
    raise TypeError(f"cannot cut an order of type {dtype.simpleString()} into segments")


def _whole(x: Column) -> Column:
    """Floor as a long; infinities and NaN go to the ends, where they also sort."""
    return F.floor(F.least(F.greatest(x, F.lit(-9e18)), F.lit(9e18))).cast("long")


@dataclass(frozen=True)
class Layout:
    """Which keys are cut, and where. ``hot`` is None when every row is cut (no keys)."""

    keys: tuple[str, ...]
    order: str
    borders: Borders | None
    hot: DataFrame | None

    @property
    def plain(self) -> bool:
        """No key needs cutting."""
        return self.borders is None

    def attach(self, df: DataFrame) -> DataFrame:
        if SEGMENT in df.columns or self.plain:
            return df
        segment = segment_of(order_number(df, self.order), self.borders)
        if self.hot is None:
            return df.withColumn(SEGMENT, segment)
        # at most two hot keys per segment can exist, so this list has a fixed bound
        marked = df.withColumn(GROUP, F.struct(*self.keys)).join(F.broadcast(self.hot), GROUP, "left")
        return marked.withColumn(SEGMENT, F.when(F.col("__hot"), segment).otherwise(0)).drop(GROUP, "__hot")


def find_layout(df: DataFrame, keys: Sequence[str], order: str, fan: int | None = None) -> Layout:
    """Look for keys above a fair share, and for borders if there are any.

    The look at the keys takes a sample of about ``SAMPLE_ROWS`` rows; it decides
    where rows are processed and never which. A key counts as hot from half of one
    segment's share.
    """
    fan = fan or default_fan(df)
    order_number(df, order)  # an order that can't be cut fails at every size
    if not keys:
        return Layout((), order, find_borders(df, order, fan), None)
    spark = df.sparkSession
    total = df.select(*keys).count()
    part = df.select(F.struct(*keys).alias(GROUP))
    if total > SAMPLE_ROWS:
        part = part.sample(SAMPLE_ROWS / total, seed=7)
    floor = max(MIN_HOT_ROWS, min(total, SAMPLE_ROWS) / (2 * fan**LEVELS))
    found = part.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor).select(GROUP)
    rows = found.collect()
    if not rows:
        return Layout(tuple(keys), order, None, None)
    hot = spark.createDataFrame(rows, found.schema).withColumn("__hot", F.lit(True))
    return Layout(tuple(keys), order, find_borders(df.join(F.broadcast(hot), F.struct(*keys) == F.col(GROUP), "left_semi"), order, fan), hot)


def default_fan(df: DataFrame) -> int:
    """Fan that gives about four segments per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, min(32, math.ceil((4 * parts) ** (1 / LEVELS))))


def find_borders(df: DataFrame, order: str, fan: int | None = None) -> Borders:
    """Equal-depth borders of ``order``.

    Sketches of the tasks are merged in groups, and the groups' quantiles, weighted
    by their rows, give the borders: no task receives every sketch, and only the
    borders (at most 32**3 numbers) reach the driver.
    """
    fan = fan or default_fan(df)
    steps = fan**LEVELS
    points = F.from_json(F.lit(json.dumps([i / steps for i in range(1, steps)])), "array<double>")
    x = order_number(df, order).alias("x")
    groups = df.select(x, F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g")).where("x IS NOT NULL").groupBy("g")
    parts = groups.agg(F.percentile_approx("x", points, max(1000, 2 * steps)).alias("b"), F.count(F.lit(1)).alias("n"))
    row = parts.select(F.explode("b").alias("x"), "n").agg(F.percentile("x", points, F.col("n")).alias("b")).first()
    return Borders(fan, tuple(sorted(int(v) for v in row["b"] or [])))


def segment_of(value: Column, borders: Borders) -> Column:
    """Number of the segment of a value: ``LEVELS`` steps of ``fan`` comparisons.

    The borders are one folded literal, a list of nodes per level. The value is
    bound to a lambda variable, so it is computed once per row.
    """
    if not borders.values:
        return F.lit(0)
    fan, levels = borders.fan, []
    for level in range(LEVELS):
        width = fan ** (LEVELS - level)
        levels.append([[borders.values[n * width + k * width // fan - 1] for k in range(1, fan)] for n in range(fan**level)])
    grid = F.from_json(F.lit(json.dumps(levels)), "array<array<array<bigint>>>")

    def search(v: Column) -> Column:
        return F.aggregate(grid, F.lit(0), lambda node, marks: node * fan + F.size(F.filter(F.element_at(marks, node + 1), lambda m: m <= v)))

    return F.transform(F.array(value), search)[0]


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and segment as one struct: it is never null and equal structs match even
    where a key is null, so windows and the carry join share one shuffle."""
    return df.withColumn(GROUP, F.struct(*keys, SEGMENT))


def _join_carry(base: DataFrame, carry: DataFrame) -> DataFrame:
    return base.join(carry, GROUP, "left").drop(GROUP)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    calcs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    whole: dict[str, tuple[str, Column]] | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Running sum/max/min per key in ``order``; ``exclusive`` leaves the row itself out.

    ``calcs`` maps an output name to (function, value). The value is null where a
    row does not take part. The result is null while nothing has taken part yet.
    ``whole`` adds aggregates over all rows of the key, from the same carry table.
    """
    layout = layout or find_layout(df, keys, order[0])
    whole = whole or {}
    last = -1 if exclusive else 0
    if layout.plain:
        w = Window.partitionBy(*keys)
        frame = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.select(
            "*", *[_FNS[fn](v).over(frame).alias(out) for out, (fn, v) in calcs.items()], *[_FNS[fn](v).over(w).alias(out) for out, (fn, v) in whole.items()]
        )
    base = _grouped(layout.attach(df), keys)
    for out, (_, value) in {**calcs, **whole}.items():
        base = base.withColumn(f"__v_{out}", value)
    within = Window.partitionBy(GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    per_key = Window.partitionBy(*[F.col(GROUP)[k] for k in keys])
    before = per_key.orderBy(F.col(GROUP)[SEGMENT]).rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(GROUP).agg(*[_FNS[fn](f"__v_{out}").alias(f"__v_{out}") for out, (fn, _) in {**calcs, **whole}.items()])
    carry = carry.select(
        GROUP,
        *[_FNS[fn](f"__v_{out}").over(before).alias(f"__c_{out}") for out, (fn, _) in calcs.items()],
        *[_FNS[fn](f"__v_{out}").over(per_key).alias(out) for out, (fn, _) in whole.items()],
    )
    local = base.select("*", *[_FNS[fn](f"__v_{out}").over(within).alias(f"__l_{out}") for out, (fn, _) in calcs.items()])
    joined = _join_carry(local.drop(*[f"__v_{out}" for out in [*calcs, *whole]]), carry)
    outs = {}
    for out, (fn, _) in calcs.items():
        l, c = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        outs[out] = F.coalesce(l + c, l, c) if fn == "sum" else F.greatest(l, c) if fn == "max" else F.least(l, c)
    joined = joined.withColumns(outs).drop(*[f"__{p}_{out}" for out in calcs for p in ("l", "c")])
    return joined.drop(SEGMENT)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], layout: Layout | None = None) -> DataFrame:
    """Value of the previous row of the same key; null on the first row."""
    layout = layout or find_layout(df, keys, order[0])
    if layout.plain:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(v).over(w).alias(k) for k, v in values.items()])
    base = _grouped(layout.attach(df), keys)
    base = base.withColumn("__v", F.struct(*[v.alias(k) for k, v in values.items()]))
    within = Window.partitionBy(GROUP).orderBy(*order)
    carry = base.groupBy(GROUP).agg(F.max_by("__v", F.struct(*order)).alias("__c"))
    per_key = Window.partitionBy(*[F.col(GROUP)[k] for k in keys]).orderBy(F.col(GROUP)[SEGMENT])
    carry = carry.select(GROUP, F.lag("__c").over(per_key).alias("__c"))
    joined = _join_carry(base.withColumn("__l", F.lag("__v").over(within)), carry)
    joined = joined.withColumn("__p", F.coalesce("__l", "__c"))
    joined = joined.select("*", *[F.col("__p")[k].alias(k) for k in values]).drop("__v", "__l", "__c", "__p")
    return joined.drop(SEGMENT)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, reset: Column, out: str, layout: Layout | None = None) -> DataFrame:
    """Weight gathered since the last reset, in one shuffle.

    Inside a segment it is the running weight minus the running weight at the last
    reset. A segment hands on its total weight and, if it had a reset, the weight
    after the last one.
    """
    layout = layout or find_layout(df, keys, order[0])
    if layout.plain:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = df.withColumn("__r", reset).withColumn("__sum", F.sum(weight).over(w))
        last = F.last(F.when(F.col("__r"), F.col("__sum")), ignorenulls=True).over(w)
        return summed.withColumn(out, F.col("__sum") - F.coalesce(last, F.lit(0))).drop("__r", "__sum")
    base = _grouped(layout.attach(df), keys).withColumn("__w", weight).withColumn("__r", reset)
    w = Window.partitionBy(GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("__sum", F.sum("__w").over(w))
    local = local.withColumn("__at", F.last(F.when(F.col("__r"), F.col("__sum")), ignorenulls=True).over(w))
    at_reset = F.max_by(F.when(F.col("__r"), F.col("__sum")), F.when(F.col("__r"), F.struct(*order)))
    ends = local.groupBy(GROUP).agg(F.sum("__w").alias("__total"), at_reset.alias("__last"))
    per_key = Window.partitionBy(*[F.col(GROUP)[k] for k in keys]).orderBy(F.col(GROUP)[SEGMENT]).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__sum_before", F.coalesce(F.sum("__total").over(per_key), F.lit(0)))
    ends = ends.select(GROUP, "__sum_before", F.last(F.col("__sum_before") + F.col("__last"), ignorenulls=True).over(per_key).alias("__at_before"))
    joined = _join_carry(local, ends)
    value = F.col("__sum") + F.col("__sum_before") - F.coalesce(F.col("__at") + F.col("__sum_before"), F.col("__at_before"), F.lit(0))
    joined = joined.withColumn(out, value).drop("__w", "__r", "__sum", "__at", "__sum_before", "__at_before")
    return joined.drop(SEGMENT)


def _scaled(value: str) -> Column:
    """Order-keeping long of a number, in thousandths."""
    return _whole(F.col(value).cast("double") * 1000)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Interpolated quantiles per key without holding a group in memory.

    ``weight`` says how often a row's value counts.

    Equal values are counted first (partial aggregation), ranks come from a
    running count, and each quantile is the pair of values at the two neighbouring
    ranks.
    """
    layout = find_layout(df.withColumn("__ord", _scaled(value)), keys, "__ord")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__n"))
    ranked = counted.withColumn("__ord", _scaled(value))
    n = F.col("__n")
    joined = running(ranked, keys, ["__ord", value], {"__cum": ("sum", n)}, whole={"__total": ("sum", n)}, layout=layout)
    aggs = []
    for out, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        aggs.append(F.min(F.when(F.col("__cum") > F.floor(pos), F.col(value))).alias(f"__lo_{out}"))
        aggs.append(F.min(F.when(F.col("__cum") > F.ceil(pos), F.col(value))).alias(f"__hi_{out}"))
    found = joined.groupBy(*keys).agg(F.max("__total").alias("n"), *aggs)
    outs = []
    for out, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{out}").cast("double"), F.col(f"__hi_{out}").cast("double")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(out))
    return found.select(*keys, "n", *outs)
