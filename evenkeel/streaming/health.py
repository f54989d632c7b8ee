"""Health checks and alerts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from evenkeel.operators.telemetry import route
from evenkeel.streaming import keyed as kd
from evenkeel.streaming.changes import run_available
from evenkeel.streaming.state import KeyedState


def heartbeat_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "target", order: tuple[str, ...] = ("ts", "id"), threshold: int = 3) -> StreamingQuery:
    """Failure streaks across micro-batches, kept per target in Spark's keyed state.

    Results are appended to Parquet files at ``out``; each check is in them once, also
    after a restart.
    """
    schema = StructType([*stream.schema.fields, StructField("streak", LongType()), StructField("alarm", BooleanType())])
    beats = stream.groupBy(key).transformWithState(kd.Streaks(stream.columns, order, threshold), schema, "Append", "None")
    with kd.rocksdb(stream.sparkSession):
        return run_available(beats.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def failover_events(beats: DataFrame) -> DataFrame:
    """Streaks to events to actions (C10). Works on batch and streaming frames."""
    kind = F.when(F.col("alarm"), "health_threshold_reached").when(F.col("streak") > 0, "health_degraded").otherwise("healthy")
    return route(beats.withColumn("kind", kind), "kind")


def upsert_windows(stream: DataFrame, state: KeyedState, checkpoint: str) -> StreamingQuery:
    """Windowed aggregates in update mode: the newest value of each window wins."""

    def each(batch: DataFrame, batch_id: int) -> None:
        state.write(batch_id, batch)

    return run_available(stream.writeStream.outputMode("update").foreachBatch(each), checkpoint)
