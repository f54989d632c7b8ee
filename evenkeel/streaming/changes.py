"""Change streams: tolerant reading, ordered replay, checkpoints, late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evenkeel.operators import replay as rp
from evenkeel.sources.readers import CORRUPT, parse_queue
from evenkeel.streaming import keyed as kd
from evenkeel.streaming.state import KeyedState


def change_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines queue as a stream; Spark's own checkpoint remembers what was read."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_queue(reader.load(folder), schema)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a table as a stream; ``path`` may be one file or a folder.

    The path is given as a pattern that matches only itself: a plain path has to
    be a folder, a pattern does not.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything there is now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def queue_to_table(stream: DataFrame, out: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Good changes to Parquet, broken lines to the dead-letter folder.

    Both writes go to a folder of the batch, so a repeated batch replaces itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two sinks read it
        good = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        good.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        bad = batch.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
        write_dead_letter_batch(bad, dead, batch_id)
        batch.unpersist()

    return run_available(stream.writeStream.foreachBatch(each), checkpoint)


def write_dead_letter_batch(bad: DataFrame, dead: str, batch_id: int) -> None:
    bad.withColumn("reject_reason", F.lit("invalid JSON")).write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")


def replay_stream(
    stream: DataFrame,
    state: KeyedState,
    marks: KeyedState,
    checkpoint: str,
    seq: str = "seq",
    table: str = "table",
    ts: str = "ts",
    policy: rp.Policy = rp.Policy(),
    dead: str | None = None,
    carried: str | None = None,
) -> StreamingQuery:
    """Ordered replay with Spark's keyed state, and a checkpoint per table.

    The row, its life and its last position are the state of the key; a micro-batch
    touches the keys that it has changes for. ``state`` is the sink: it gets the new
    version of each touched row. Spark's checkpoint takes every file once; beyond that a
    change is ignored only if its own key is already further, so files with interleaving
    positions lose nothing. Late changes and those that the policy skipped go to
    ``dead``, if given, each with its reason.
    """
    pk = list(state.keys)
    row = StructType.fromDDL(state.schema)
    cols = [f for f in row.fields if f.name not in pk]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    kept = ", ".join(["alive boolean", f"last {kinds[seq]}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)])
    schema = kd.replay_schema(pk, row, kinds, seq, ts, table)
    names = StructType.fromDDL(schema).names
    processor = kd.Replay(pk, [f.name for f in cols], names, kept, seq, ts, table, policy, carried)
    replayed = stream.groupBy(*pk).transformWithState(processor, schema, "Update", "None")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # three sinks read it
        state.write(batch_id, batch.where(F.col("__kind") == kd.ROW).select(*row.names, "alive"))
        if dead is not None:
            failed = batch.where(F.col("__kind") == kd.REJECTED).select(*pk, F.col("__seq").alias(seq), F.col("__op").alias("op"), F.col("__reason").alias("reject_reason"))
            failed.write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")
        new = batch.where(F.col("__kind") == kd.MARK).groupBy(F.col("__table").alias(table))
        new = new.agg(F.max("__seq").alias("last_seq"), F.max("__ts").alias("last_timestamp"), F.sum("__n").alias("rows_applied"))
        marks.write(batch_id, rp.merge_checkpoint(marks.before(batch_id), new, table))  # one row for each table
        batch.unpersist()

    with kd.rocksdb(state.spark):
        return run_available(replayed.writeStream.outputMode("update").foreachBatch(each), checkpoint)


def dedupe_stream(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Each change once while its repeats arrive within the delay (C14)."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
