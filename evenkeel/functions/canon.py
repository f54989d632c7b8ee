"""Canonical text form of a value and the row fingerprint built on it.

Two engines print the same value in different ways, so a hash is only taken
over the canonical form: nulls become a token, timestamps UTC text, numbers a
fixed precision, text is trimmed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NULL_TOKEN = "~"
FIELD_SEPARATOR = "|"


def canon(col: Column, dtype: T.DataType, scale: int = 6, null_token: str = NULL_TOKEN) -> Column:
    """Canonical text, nulls as the token."""
    return F.coalesce(canon_text(col, dtype, scale), F.lit(null_token))


def sized(text: Column) -> Column:
    """Text with its length in front, nulls as the bare token: fields joined in this form can't run into each other."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_TOKEN))


def canon_text(col: Column, dtype: T.DataType, scale: int = 6) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = col.cast(T.DecimalType(38, scale)).cast("string")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dtype, T.DateType):
        text = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(dtype, T.BooleanType):
        text = F.when(col, "1").when(~col, "0")
    elif isinstance(dtype, T.BinaryType):
        text = F.lower(F.hex(col))
    elif isinstance(dtype, T.StringType):
        text = F.trim(col)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return text


def canon_columns(df: DataFrame, cols: Sequence[str] | None = None, scale: int = 6, with_size: bool = True) -> list[Column]:
    """Canonical fields. ``with_size=False`` is the plain form, in which text may imitate separators and null tokens."""
    names = list(cols) if cols else df.columns
    form = sized if with_size else (lambda text: F.coalesce(text, F.lit(NULL_TOKEN)))
    return [form(canon_text(F.col(f"`{n}`"), df.schema[n].dataType, scale)) for n in names]


def raw_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
    """Plain cast to text: the un-normalised form (Q02)."""
    names = list(cols) if cols else df.columns
    return [sized(F.col(f"`{n}`").cast("string")) for n in names]


def row_text(df: DataFrame, cols: Sequence[str] | None = None, separator: str = FIELD_SEPARATOR, with_size: bool = True) -> Column:
    return F.concat_ws(separator, *canon_columns(df, cols, with_size=with_size))


def row_md5(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return F.md5(row_text(df, cols))


def digest_number(md5_hex: Column) -> Column:
    """First 15 hex digits as a long (< 2^60), so a sum fits decimal(38,0)."""
    return F.conv(F.substring(md5_hex, 1, 15), 16, 10).cast("long")



def wide_sum(col: Column) -> Column:
    return F.sum(col.cast(T.DecimalType(28, 0)))
