"""Small helpers shared by the text operators.

All operators read ``doc_id`` and ``text`` only (``lang`` where stated). A null text
counts as the empty text. ``doc_id`` may be null or repeated: where rows have to be
told apart, the key is a 64-bit hash of both columns, so rows that agree in both are
one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

ROWS = 1024  # rows handled at once inside a task


def text_col(docs: DataFrame):
    return F.coalesce(docs["text"], F.lit(""))


def doc_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"], text_col(docs))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key`` only; other columns, whatever their names, stay behind."""
    return docs.select(docs["doc_id"].alias("doc_id"), text_col(docs).alias("text"), doc_key(docs).alias("key"))


def free_name(docs: DataFrame, wish: str) -> str:
    """``wish``, or a longer name if the table already has such a column."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def batches(stream: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def add_columns(docs: DataFrame, fields: list[tuple[str, DataType]], make: Callable[[], Callable[[list[str]], list[pa.Array]]], column: str = "text", rows: int = ROWS) -> DataFrame:
    """Every row of ``docs`` with new columns made from its text.

    ``make()`` runs once in each task and returns a function from a list of texts to
    one Arrow array per new field. Rows are passed through as they are.
    """
    schema = StructType(docs.schema.fields + [StructField(n, t, True) for n, t in fields])
    index = docs.columns.index(column)

    def work(stream):
        call = make()
        for batch in batches(stream, rows):
            texts = [t or "" for t in batch.column(index).to_pylist()]
            names = [*batch.schema.names, *(n for n, _ in fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *call(texts)], names=names)

    return docs.mapInArrow(work, schema)
