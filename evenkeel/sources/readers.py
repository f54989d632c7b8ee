"""Scans (S01-S09, S11, S12)."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Columns of the fleet registry and of the export manifest.
FLEET_SCHEMA = (
    "platform string, engine string, version string, environment string, region string, criticality string, tier string, "
    "owner_team string, service_name string, rpo_minutes int, rto_minutes int, ha_mode string, backup_policy string, "
    "patch_window string, compliance_tags string"
)
MANIFEST_SCHEMA = (
    "table_name string, chunk_id string, export_start_ts timestamp, export_end_ts timestamp, anchor_scn long, row_count long, "
    "file_size_bytes long, checksum_sha256 string, source_path string, databox_path string, status string"
)
CORRUPT = "_corrupt"


def csv_reader(spark: SparkSession, multi_line: bool):
    """Header CSV with doubled quotes inside quotes."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def infer_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """Types that hold every value of the table, from one distributed pass over all of it."""
    schema = csv_reader(spark, multi_line).option("inferSchema", True).csv(path).schema
    if not schema.fields:
        raise ValueError(f"no header in {path}")
    return schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV with one schema for the whole table.

    Without a schema the types are inferred from all rows, so they are never narrower
    than the data. A row that doesn't fit a given schema, or has other columns than the
    header, is kept as text in ``_corrupt``. ``multi_line`` reads fields with line breaks
    inside quotes; a file is then one task.
    """
    wanted = infer_schema(spark, path, multi_line) if schema is None else _struct(schema)
    if CORRUPT not in wanted.names:
        wanted = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    schema = wanted
    return csv_reader(spark, multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Path, size and stem of all files, empty ones too, which Spark's own listing leaves out; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if fnmatch(name, glob) and not name.startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen(), name.rpartition(".")[0]))
    return spark.createDataFrame(found, "path string, length long, stem string")


POOL = 8  # files that are looked at side by side; each has jobs of its own


def in_pool(call, items: Sequence) -> list:
    """``call`` for each item, a bounded number at a time, in order."""
    with ThreadPoolExecutor(POOL) as pool:
        return list(pool.map(call, items))


def read_csv_dir(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """One table per CSV stem, and a report of files that could not be opened.

    Each file is opened and its types inferred here, so a bad one is found now.
    """

    def opened(row):
        try:
            return read_csv(spark, row.path, schema, multi_line=True), None
        except Exception as err:  # a bad file must not stop the others
            return None, str(err).splitlines()[0]

    rows = list_files(spark, folder, "*.csv").orderBy("path").collect()
    done = list(zip(rows, in_pool(opened, rows)))
    return {r.stem: df for r, (df, err) in done if err is None}, [(r.path, err) for r, (_, err) in done if err is not None]


def rows_per_file(spark: SparkSession, folder: str, glob: str = "*.csv", header: bool = True, multi_line: bool = True) -> DataFrame:
    """Data rows of every file of a folder in one scan.

    The CSV reader counts, so a line break inside quotes starts no row. Where no field
    has one, ``multi_line=False`` lets large files be split between tasks.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("header", header).option("multiLine", multi_line).option("escape", '"')
    rows = reader.schema("__first string").csv(folder)
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Indented JSON array (S03). One file is one task; split exports into many files."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def parse_queue(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """JSON lines to typed rows; blank lines vanish, bad ones keep their text in ``_corrupt``."""
    full = T.StructType([*_struct(schema).fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_change_queue(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines change queue, tolerant of blank and broken lines."""
    return parse_queue(spark.read.text(path), schema)


def to_whole(col: str) -> Column:
    """Number in text to a whole number, cut toward zero; nothing means 0."""
    return F.coalesce(F.expr(f"try_cast(try_cast(`{col}` AS double) AS bigint)"), F.lit(0)).alias(col)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary CSV read as text, its counts through ``to_whole``; ``pos`` keeps file order for last-row-wins."""
    text = spark.read.option("header", True).schema(
        "schema_name string, table_name string, row_count string, hash_sum string, updated_count string, deleted_count string, run_ts string"
    ).csv(path)
    return text.select(
        F.coalesce("schema_name", F.lit("")).alias("schema_name"),
        F.coalesce("table_name", F.lit("")).alias("table_name"),
        to_whole("row_count"),
        F.coalesce("hash_sum", F.lit("")).alias("hash_sum"),
        to_whole("updated_count"),
        to_whole("deleted_count"),
        "run_ts",
        F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("n")).alias("pos"),
    )


def jdbc_options(url: str, table: str, pk: str | None = None, bounds: tuple | None = None, num_partitions: int = 1, fetch_size: int = 10000) -> dict[str, str]:
    """Options of a key-partitioned JDBC scan."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if pk is not None:
        if bounds is None or num_partitions < 1:
            raise ValueError("a partitioned scan needs bounds and num_partitions")
        options |= {"partitionColumn": pk, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(num_partitions)}
    return options


def read_jdbc(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """Full load of a database table."""
    return spark.read.format("jdbc").options(**jdbc_options(*args, **kwargs)).load()


def from_rows(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """A handful of driver rows."""
    return spark.createDataFrame(list(rows), schema)


def generated_rows(spark: SparkSession, n: int, **exprs: Column) -> DataFrame:
    """Any number of rows made by the executors."""
    return spark.range(n).select("id", *[e.alias(k) for k, e in exprs.items()])


def bronze(df: DataFrame, load_id: str) -> DataFrame:
    """Source rows as they are, plus where they came from."""
    return df.select("*", F.col("_metadata.file_name").alias("_source_file"), F.lit(load_id).alias("_load_id"))


def read_fleet(spark: SparkSession, path: str) -> DataFrame:
    """Fleet registry CSV."""
    return spark.read.option("header", True).schema(FLEET_SCHEMA).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MANIFEST_SCHEMA).csv(path)


def build_manifest(spark: SparkSession, folder: str, table: str, anchor: int, glob: str = "*.parquet") -> DataFrame:
    """Bytes and SHA-256 of every export chunk.

    A file is one value here (2 GB at most); for larger files compare
    ``bucket_hash`` of the rows instead.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.lit(table).alias("table_name"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("chunk_id"),
        F.lit(anchor).cast("long").alias("anchor_scn"),
        F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("checksum_sha256"),
    )


def manifest_with_rows(manifest: DataFrame, table: DataFrame) -> DataFrame:
    """Adds the row count of each chunk, counted from the table's own scan."""
    per = table.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("chunk_id")).agg(F.count(F.lit(1)).alias("row_count"))
    return manifest.join(per, "chunk_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Chunk by chunk: OK, MISSING, UNEXPECTED, SIZE or CHECKSUM."""
    m = manifest.select("table_name", "chunk_id", F.col("file_size_bytes").alias("m_size"), F.col("checksum_sha256").alias("m_sum"))
    f = found.select("table_name", "chunk_id", F.col("file_size_bytes").alias("f_size"), F.col("checksum_sha256").alias("f_sum"))
    status = (
        F.when(F.col("f_sum").isNull(), "MISSING")
        .when(F.col("m_sum").isNull(), "UNEXPECTED")
        .when(F.col("m_size") != F.col("f_size"), "SIZE")
        .when(F.col("m_sum") != F.col("f_sum"), "CHECKSUM")
        .otherwise("OK")
    )
    return m.join(f, ["table_name", "chunk_id"], "full_outer").select("table_name", "chunk_id", status.alias("status"))
