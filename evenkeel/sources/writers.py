"""Sinks (K01-K08, S09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from evenkeel.operators.fingerprint import bucket_of
from evenkeel.operators.marts import newest, with_as_of
from evenkeel.sources.readers import CORRUPT, in_pool, list_files, read_csv

CODECS = ("snappy", "gzip", "zstd", "none")
# text formats cut times to milliseconds unless told otherwise
FULL_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", rows_per_file: int | None = None) -> None:
    if compression not in CODECS:
        raise ValueError(f"codec {compression!r} is not available; use one of {', '.join(CODECS)}")
    writer = df.write.mode("errorifexists").option("compression", compression)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


TOTALS = "rows_read long, rows_written long, bad_rows long"


def csv_to_parquet(spark: SparkSession, source: str, target: str, compression: str = "snappy", rows_per_file: int | None = None, schema=None, quarantine: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV table to Parquet part files, with one schema for all of them.

    One read writes the rows and counts them. Rows that don't fit the schema are never
    written with nulls in place of their values: they go to ``quarantine`` as text, or,
    without one, the conversion ends with an error after the good rows were written.
    Returns the totals.
    """
    rows = read_csv(spark, source, schema, multi_line)
    read, written = Observation(), Observation()
    seen = rows.observe(read, F.count(F.lit(1)).alias("rows_read"), F.count(CORRUPT).alias("bad_rows"))
    good = seen.where(F.col(CORRUPT).isNull()).drop(CORRUPT).observe(written, F.count(F.lit(1)).alias("rows_written"))
    write_parquet(good, target, compression, rows_per_file)
    totals = read.get | written.get
    if totals["bad_rows"] and quarantine is None:
        raise ValueError(f"{totals['bad_rows']} of {totals['rows_read']} rows of {source} don't fit the schema")
    if totals["bad_rows"]:
        write_dead_letter(rows.where(F.col(CORRUPT).isNotNull()), quarantine, "does not fit the schema")
    return spark.createDataFrame([(totals["rows_read"], totals["rows_written"], totals["bad_rows"])], TOTALS)


def convert_csv_folder(spark: SparkSession, folder: str, target: str, compression: str = "snappy") -> DataFrame:
    """Every CSV file of a folder to a Parquet table named after its stem.

    ``stem, rows_read, rows_written, bad_rows, error``: a file that can't be converted has
    its error and stops no other.
    """
    found = list_files(spark, folder, "*.csv").select("path", "stem").orderBy("path").collect()

    def converted(row) -> tuple:
        try:
            totals = csv_to_parquet(spark, row.path, f"{target}/{row.stem}", compression, quarantine=f"{target}/_rejected/{row.stem}", multi_line=True).first()
            return (row.stem, *totals, None)
        except Exception as err:  # a bad file must not stop the others
            return row.stem, None, None, None, str(err).splitlines()[0]

    report = in_pool(converted, found)
    return spark.createDataFrame(report, f"stem string, {TOTALS}, error string")


def write_csv_report(df: DataFrame, path: str, columns: list[str] | None = None, order_by: list[Column] | None = None) -> None:
    """Header CSV with a fixed column order, sorted over all part files if asked."""
    out = df.orderBy(*order_by) if order_by else df
    out.select(*(columns or df.columns)).write.mode("overwrite").options(**FULL_TIMES).option("header", True).option("escape", '"').csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per result; null members are left out."""
    df.write.mode("overwrite").options(**FULL_TIMES).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Indented JSON arrays, one per task, written as the rows stream by."""
    items = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", **FULL_TIMES}).alias("value"))

    def bracket(batches):
        import pandas as pd

        lead = "["
        for batch in batches:
            if len(batch):
                text = batch["value"].copy()
                text.iloc[1:] = ",\n" + text.iloc[1:]
                text.iloc[0] = lead + "\n" + text.iloc[0]
                lead = ","
                yield pd.DataFrame({"value": text})
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    items.mapInPandas(bracket, "value string").write.text(path)


def append_changes(df: DataFrame, path: str) -> None:
    """Append change events to a JSON-lines queue."""
    df.write.mode("append").options(**FULL_TIMES).json(path)


def load_replace(df: DataFrame, table: str) -> None:
    """Replace a managed table."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def save_snapshot(df: DataFrame, path: str, run_id: str, role: str) -> None:
    """Replace the rows of one run and role, leave all others."""
    out = df.withColumn("run_id", F.lit(run_id)).withColumn("role_name", F.lit(role))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "role_name").parquet(path)


def write_dead_letter(df: DataFrame, path: str, reason: str) -> None:
    """Keep rejected events with the reason."""
    df.withColumn("reject_reason", F.lit(reason)).write.mode("append").options(**FULL_TIMES).json(path)


def split_retention(df: DataFrame, ts: str, days: int = 7, as_of: DataFrame | None = None) -> DataFrame:
    """Rows marked kept or purged."""
    out = with_as_of(df, newest(df, ts) if as_of is None else as_of)
    return out.withColumn("kept", F.col(ts) >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("as_of")


def apply_retention(df: DataFrame, ts: str, days: int = 7, as_of: DataFrame | None = None) -> DataFrame:
    """Rows that stay (K08); write them to a new place, or drop whole partitions."""
    return split_retention(df, ts, days, as_of).where("kept").drop("kept")


def write_range_partitioned(df: DataFrame, ts: str, path: str, grain: str = "month") -> None:
    """Range-partitioned table: one folder per month, year or day.

    Rows are rebalanced by period: small periods share a task, and one that holds
    most of the rows is split over many, so files come out even.
    """
    fmt = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[grain]
    df.withColumn("period", F.date_format(ts, fmt)).hint("rebalance", "period").write.mode("errorifexists").partitionBy("period").parquet(path)


def write_colocated(df: DataFrame, table: str, pk: str, path: str, modulus: int = 1024, files: int = 64) -> DataFrame:
    """Table with its rows' ``bucket_id``, bucketed by it: tables written alike join without a shuffle.

    Worth it for tables that are compared again and again. Rows are shuffled once here, so
    that each of the ``files`` buckets is one file.
    """
    placed = df.withColumn("bucket_id", bucket_of(df, pk, modulus)).repartition(files, "bucket_id")
    placed.write.bucketBy(files, "bucket_id").sortBy("bucket_id").option("path", path).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def read_range(spark: SparkSession, path: str, low: str, high: str) -> DataFrame:
    """Periods in [low, high); other folders are not listed into the scan."""
    return spark.read.parquet(path).where((F.col("period") >= low) & (F.col("period") < high))
