"""Table-mapping rules and type mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# Source type to target type, per target.
TYPE_MAPS = {
    "postgresql": {
        "NUMBER": "numeric", "INTEGER": "integer", "VARCHAR2": "text", "VARCHAR": "text", "CHAR": "char", "DATE": "timestamp",
        "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp with time zone", "BLOB": "bytea", "RAW": "bytea",
        "CLOB": "text", "LONG": "text", "FLOAT": "float8",
    },
    "spark": {
        "NUMBER": "double", "INTEGER": "bigint", "VARCHAR2": "string", "VARCHAR": "string", "CHAR": "string", "DATE": "timestamp",
        "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp", "BLOB": "binary", "RAW": "binary",
        "CLOB": "string", "LONG": "string", "FLOAT": "double",
    },
}


@dataclass(frozen=True)
class MappingRule:
    """action: include, exclude, convert-lowercase, rename-schema, change-data-type."""

    action: str
    schema: str = "%"
    table: str = "%"
    column: str = "%"
    value: str | None = None


def apply_mappings(catalog: DataFrame, rules: list[MappingRule]) -> DataFrame:
    """Selected catalogue rows with their target names and types.

    Patterns are LIKE patterns (``%`` and ``_``). An exclude beats any include.
    Transformations look at the source names and apply in the order given.
    """

    def hits(r: MappingRule):
        cond = F.col("schema_name").like(r.schema) & F.col("table_name").like(r.table)
        return cond & F.col("column_name").like(r.column) if "column_name" in catalog.columns else cond

    wanted, banned = F.lit(False), F.lit(False)
    for r in rules:
        if r.action == "include":
            wanted = wanted | hits(r)
        elif r.action == "exclude":
            banned = banned | hits(r)
    schema, table = F.col("schema_name"), F.col("table_name")
    dtype = F.col("data_type") if "data_type" in catalog.columns else None
    for r in rules:
        if r.action == "convert-lowercase":
            table = F.when(hits(r), F.lower(table)).otherwise(table)
        elif r.action == "rename-schema":
            schema = F.when(hits(r), F.lit(r.value)).otherwise(schema)
        elif r.action == "change-data-type" and dtype is not None:
            source, target = (r.value or "").split("->")
            dtype = F.when(hits(r) & (F.col("data_type") == source), F.lit(target)).otherwise(dtype)
    out = catalog.where(wanted & ~banned).withColumn("target_schema", schema).withColumn("target_table", table)
    return out if dtype is None else out.withColumn("target_type", dtype)


def map_types(columns: DataFrame, target: str, source: str = "data_type") -> DataFrame:
    """Target type of each column; NUMBER goes by precision and scale when known."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_MAPS[target].items() for x in kv])
    base = F.try_element_at(table, F.upper(F.trim(F.regexp_replace(source, r"\(.*\)", ""))))
    p = F.expr(f"try_cast(regexp_extract({source}, '[(]([0-9]+)', 1) AS int)")
    s = F.coalesce(F.expr(f"try_cast(regexp_extract({source}, ',[ ]*([0-9]+)', 1) AS int)"), F.lit(0))
    whole = F.when(p <= 9, "integer" if target == "postgresql" else "int").when(p <= 18, "bigint")
    exact = "numeric" if target == "postgresql" else "decimal"
    precise = F.concat(F.lit(exact + "("), p, F.lit(","), s, F.lit(")"))
    number = F.when(s == 0, F.coalesce(whole, precise)).otherwise(precise)
    is_number = F.upper(F.col(source)).startswith("NUMBER(")
    return columns.withColumn("target_type", F.when(is_number, number).otherwise(base))


def profile_number(df: DataFrame, col: str) -> DataFrame:
    """Range and scale of a number column, and the type they allow."""
    d = F.col(col).cast("decimal(38,10)")
    scale = F.lit(10)
    for digits in range(9, -1, -1):
        scale = F.when(d == F.round(d, digits), digits).otherwise(scale)
    one = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.coalesce(F.max(scale), F.lit(0)).alias("max_scale"))
    big = F.greatest(F.abs("lo"), F.abs("hi"))
    kind = (
        F.when(F.col("max_scale") > 0, F.concat(F.lit("numeric(38,"), F.col("max_scale"), F.lit(")")))
        .when(big < 2147483648, "integer")
        .when(big < F.lit("9223372036854775808").cast("decimal(38,0)"), "bigint")
        .otherwise("numeric(38,0)")
    )
    return one.select(F.lit(col).alias("column_name"), F.col("lo").cast("double").alias("min_value"), F.col("hi").cast("double").alias("max_value"), "max_scale", kind.alias("suggested_type"))


def transform_posts(df: DataFrame, source: str, target: str, text: str) -> DataFrame:
    """Rename the owner column and add the length of the text."""
    return df.withColumnRenamed(source, target).withColumn(f"{text}_length", F.length(text))


def silver_clean(df: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rows whose cast failed."""
    typed = {c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in casts.items()}
    failed = F.lit(False)
    for c, v in typed.items():
        failed = failed | (v.isNull() & F.col(c).isNotNull())
    return df.where(~failed).withColumns(typed), df.where(failed)


def flatten_mounts(df: DataFrame, mounts: str, warn: int = 70, alert: int = 75) -> DataFrame:
    """One row per mount of each host document, with its state."""
    m = df.select(*[c for c in df.columns if c != mounts], F.explode(mounts).alias("m")).select("*", "m.*").drop("m")
    pct = F.expr("try_cast(regexp_extract(use_pct, '([0-9]+)', 1) AS int)")
    out = m.withColumn("used_percent", pct)
    return out.withColumn("state", F.when(F.col("used_percent") >= alert, "ALERT").when(F.col("used_percent") >= warn, "WARN").otherwise("OK"))
