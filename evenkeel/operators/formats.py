"""Storage-format comparison."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def release(spark: SparkSession, written: str) -> None:
    """Remove a folder of files that were measured and are not read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def format_bench(df: DataFrame, folder: str, value: str, formats: Sequence[str] = FORMATS, codecs: Mapping[str, str] | None = None, keep: bool = True) -> DataFrame:
    """Bytes, size relative to the first format, scan time and what the scan found (rows, sum of ``value``) per format.

    Formats whose data source is not installed are reported as unavailable.
    ``codecs`` names the compression of formats that are not to be written as Spark does by itself.
    Without ``keep``, a format's files go once they are scanned and measured, so the disk holds
    one format at a time; a folder that was there before is never written to and stays.
    """
    spark = df.sparkSession
    rows = []
    for name in formats:
        path = f"{folder}/{name}"
        try:
            codec = {"compression": codecs[name]} if codecs and name in codecs else {}
            df.write.format(name).option("header", True).options(**codec).save(path)
        except PySparkException as err:
            rows.append((name, False, None, None, None, None, str(err).splitlines()[0][:200]))
            continue
        reader = spark.read.format(name).option("header", True).schema(df.schema)
        start = time.perf_counter()
        found = reader.load(path).agg(F.count(value), F.sum(F.col(value).cast("decimal(28,6)"))).first()
        seconds = time.perf_counter() - start
        size = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.sum("length")).first()[0]
        rows.append((name, True, size, seconds, *found, ""))
        if not keep:
            release(spark, path)
    out = spark.createDataFrame(rows, "format string, available boolean, bytes long, scan_seconds double, row_count long, total decimal(38,6), note string")
    first = next((r[2] for r in rows if r[2]), None)
    return out.withColumn("relative_size", F.round(F.col("bytes") / F.lit(first), 2))
