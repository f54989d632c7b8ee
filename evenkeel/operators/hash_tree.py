"""Hash trees over key ranges: a gap is found by comparing a few nodes instead of rows (Q03).

Level 0 has the leaves, ranges of ``width`` keys; ``fanout`` nodes share a parent. A node
holds the count and hash sum of its rows, so a parent is the sum of its children. Trees are
kept as Parquet, one folder for each level, sorted by node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenkeel.functions.canon import digest_number, row_md5, wide_sum
from evenkeel.session import scratch_path


@dataclass(frozen=True)
class Shape:
    """Powers of two, so that every 64-bit key has its exact range."""

    width: int = 1024
    fanout: int = 16
    levels: int = 4  # above the leaves

    def __post_init__(self):
        if any(n < 2 or n & (n - 1) for n in (self.width, self.fanout)):
            raise ValueError("width and fanout must be powers of two")

    def leaf(self, key: Column) -> Column:
        return F.shiftright(key.cast("long"), self.width.bit_length() - 1)

    def parent(self, node: Column) -> Column:
        return F.shiftright(node, self.fanout.bit_length() - 1)

    def children(self, node: Column) -> Column:
        """A row's null key has a node of its own on each level."""
        of_range = F.transform(F.sequence(F.lit(0), F.lit(self.fanout - 1)), lambda i: node * self.fanout + i)
        return F.explode(F.when(node.isNull(), F.array(F.lit(None).cast("long"))).otherwise(of_range))


@dataclass(frozen=True)
class Descent:
    """Leaf ranges that differ, and how many nodes of both trees each level had to read."""

    ranges: DataFrame
    nodes_read: list[tuple[int, int]]


def level_path(path: str, level: int) -> str:
    return f"{path}/level={level}"


def build_tree(df: DataFrame, key: str, path: str, cols: Sequence[str] | None = None, shape: Shape = Shape()) -> None:
    """Write a table's tree. Rows are read once; each level is made from the one below."""
    leaves = df.select(shape.leaf(F.col(key)).alias("node"), digest_number(row_md5(df, cols)).alias("h"))
    level = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), wide_sum(F.col("h")).alias("h"))
    for nr in range(shape.levels + 1):
        if nr:
            below = df.sparkSession.read.parquet(level_path(path, nr - 1))
            level = below.groupBy(shape.parent(F.col("node")).alias("node")).agg(F.sum("n").alias("n"), F.sum("h").cast("decimal(38,0)").alias("h"))
        level.orderBy("node").write.parquet(level_path(path, nr))


def descend(spark: SparkSession, source: str, target: str, shape: Shape = Shape()) -> Descent:
    """Compare two trees from the top, below differing nodes only.

    A level reads the children of what differed above: their smallest and largest node
    go to the scan as a filter, a semi-join leaves the children themselves.
    """
    differing, read = None, []
    for level in range(shape.levels, -1, -1):
        sides = [spark.read.parquet(level_path(p, level)) for p in (source, target)]
        if differing is not None:
            low, high = differing.agg(F.min("node"), F.max("node")).first()
            inside = F.col("node").isNull()
            if low is not None:
                inside = inside | F.col("node").between(low * shape.fanout, high * shape.fanout + shape.fanout - 1)
            wanted = differing.select(shape.children(F.col("node")).alias("node"))
            same = lambda a, b: a["node"].eqNullSafe(b["node"])
            sides = [s.join(wanted, same(s, wanted), "left_semi") for s in (x.where(inside) for x in sides)]
        s, t = (x.select("node", F.struct("n", "h").alias(name)) for x, name in zip(sides, ("s", "t")))
        t = t.withColumnRenamed("node", "other")
        both = s.join(t, F.col("node").eqNullSafe(F.col("other")), "full_outer")
        path = scratch_path(spark, "nodes")
        both.select(F.coalesce("node", "other").alias("node"), "s", "t").write.parquet(path)
        seen = spark.read.parquet(path)
        read.append((level, seen.agg(F.count("s") + F.count("t")).first()[0]))
        differing = seen.where(~F.col("s").eqNullSafe(F.col("t")))
        if differing.isEmpty():
            break
    low = F.col("node") * shape.width
    zero = F.lit(0).cast("long")
    ranges = differing.select(
        low.alias("low"),
        (low + (shape.width - 1)).alias("high"),
        F.when(F.col("s.n").eqNullSafe(F.col("t.n")), "HASH").otherwise("COUNT").alias("difference"),
        F.coalesce("s.n", zero).alias("source_rows"),
        F.coalesce("t.n", zero).alias("target_rows"),
    )
    return Descent(ranges, read)


def rows_in(df: DataFrame, key: str, ranges: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Rows whose key lies in one of the ranges, for a row diff of what differs only."""
    low, high, nulls = ranges.agg(F.min("low"), F.max("high"), F.count_if(F.col("low").isNull())).first()
    of_null = F.col(key).isNull() if nulls else F.lit(False)
    if low is None:
        return df.where(of_null)
    inside = df.where(F.col(key).between(low, high) | of_null)
    leaves = ranges.select(shape.leaf(F.col("low")).alias("__leaf"))
    return inside.join(leaves, shape.leaf(inside[key]).eqNullSafe(F.col("__leaf")), "left_semi")
