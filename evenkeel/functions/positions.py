"""Log positions, operation codes, serialisation and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Change-table operation codes.
OP_CODES = {1: "DELETE", 2: "INSERT", 3: "UPDATE_BEFORE", 4: "UPDATE_AFTER"}

# Texts that mean "deleted", per engine.
DELETED_TOKENS = {
    "postgresql": ["1", "Y", "true", "t"],
    "mysql": ["1", "Y"],
    "oracle": ["1", "Y"],
    "sqlserver": ["1"],
}


def in_window(ts: str, start: Column, end: Column) -> Column:
    """start <= ts < end."""
    return (F.col(ts) >= start) & (F.col(ts) < end)


def is_deleted(col: str, dialect: str) -> Column:
    """Soft-delete flag as each engine spells it; null means not deleted."""
    return F.coalesce(F.col(col).cast("string"), F.lit("0")).isin(*DELETED_TOKENS[dialect])


def decode_op(col: str) -> Column:
    """Operation name of a code, SKIP for anything else."""
    out = F.when(F.lit(False), "")
    for code, name in OP_CODES.items():
        out = out.when(F.col(col) == code, name)
    return out.otherwise("SKIP")


def valid_lsn(col: str, nbytes: int = 10) -> Column:
    """Even-length hex of the expected number of bytes."""
    return F.coalesce(F.col(col).rlike("^([0-9a-fA-F]{2}){%d}$" % nbytes), F.lit(False))


def lsn_range(df: DataFrame, col: str, low: str, high: str) -> DataFrame:
    """Rows in (low, high]; equal-length lower-case hex sorts like the number."""
    if len(low) != len(high) or low.lower() >= high.lower():
        raise ValueError("log positions need equal length and low < high")
    return df.where((F.lower(col) > low.lower()) & (F.lower(col) <= high.lower()))


def serialise(df: DataFrame) -> DataFrame:
    """One JSON document per change: bytes as hex, times as ISO-8601."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            c = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        fields.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def lag_minutes(ts: Column, as_of: Column) -> Column:
    """Fractional minutes between two times."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(6e7)


def lag_minute_boundaries(ts: Column, as_of: Column) -> Column:
    """Minute boundaries crossed, the meaning of DATEDIFF(MINUTE)."""
    a = F.unix_micros(F.date_trunc("minute", as_of).cast("timestamp"))
    b = F.unix_micros(F.date_trunc("minute", ts).cast("timestamp"))
    return F.round((a - b) / F.lit(6e7)).cast("long")


def composite(lsn: str, seqval: str, code: str) -> Column:
    """Log position and place in its transaction (hexadecimal, each of a fixed width) and operation code as one binary that sorts like the three."""
    return F.unhex(F.concat(F.col(lsn), F.col(seqval), F.lpad(F.hex(F.col(code).cast("long")), 2, "0")))
