"""Changes polled by their log position.

Spark's file source remembers files and knows no order between them. Here the offset is
the position of the last change taken, so a batch is the next stretch of positions,
wherever its changes are stored, and a restart goes on behind the last one. A position
is never torn: the changes of one commit come in one batch, even where they alone exceed
the limit. A log that is far ahead may be caught up with in batches of several stretches,
each of at most ``maxChanges`` changes and whole commits; the next poll again takes what is there.

Only footers and the position column of the next row groups are read to find a batch's
end; tasks then read the row groups that the stretch touches. A log whose files are
written in order costs one or two row groups a batch.

Defined cases: changes without a position are never taken; columns that a file lacks are
null; files that arrive later with positions already passed are not taken (C14 reports
such holes); an absent or empty folder is a log without changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BATCH = 10_000  # changes in a stretch
CATCH_UP = 50  # stretches in a batch for a log that is far ahead
ROWS = 8192  # rows handled at once inside a task


class Stretch(InputPartition):
    """The changes of one row group whose positions lie in (after, upto]."""

    def __init__(self, path: str, group: int, after, upto):
        self.path, self.group, self.after, self.upto = path, group, after, upto


def log_files(folder: str) -> list[str]:
    """Parquet files below the folder; names that begin with a dot or an underscore are unfinished work."""
    fs, base = FileSystem.from_uri(folder)
    if fs.get_file_info(base).type == FileType.File:
        return [base]
    found = fs.get_file_info(FileSelector(base, allow_not_found=True, recursive=True))
    inner = [(f.path, f.path[len(base) :].strip("/").split("/")) for f in found if f.type == FileType.File]
    return sorted(path for path, parts in inner if path.endswith(".parquet") and not any(p[0] in "._" for p in parts))


class PositionReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.column = options["path"], options["position"]
        self.limit = int(options.get("maxchanges", BATCH))
        self.stretches = int(options.get("stretches", 1))
        self.names = schema.names
        self.types = arrow_types(schema)
        self.at = None  # the position up to which changes were planned
        self.groups: dict[str, list[tuple]] = {}  # of each file: lowest and highest position, number

    def opened(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(path, filesystem=FileSystem.from_uri(self.folder)[0])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the next batch, or the current position if there is nothing behind it."""
        end = self.next_end()
        return {} if end is None else {"position": end}

    def next_end(self):
        most = self.limit * self.stretches
        nearest = None  # the smallest positions not yet taken, one more than fit
        for low, high, path, number in self.touched(self.at, None):
            if nearest is not None and len(nearest) > most and nearest[-1].as_py() < low:
                break
            column = self.opened(path).read_row_group(number, columns=[self.column]).column(0)
            some = column.drop_null() if self.at is None else column.filter(pc.greater(column, self.at))
            some = pa.concat_arrays([*some.chunks, *([] if nearest is None else [nearest.cast(some.type)])]) if some.num_chunks or nearest is not None else pa.array([], some.type)
            nearest = some.take(pc.sort_indices(some)[: most + 1])
        if nearest is None or not len(nearest):
            return self.at
        end, at = self.at, 0
        for _ in range(self.stretches):
            if len(nearest) - at <= self.limit:
                return nearest[-1].as_py() if len(nearest) <= most or end is self.at else end
            beyond = nearest[at + self.limit]
            whole = nearest.slice(at, self.limit)
            whole = whole.filter(pc.less(whole, beyond))
            if not len(whole):  # one commit that exceeds the limit
                return beyond.as_py() if at == 0 else end
            end, at = whole[-1].as_py(), at + len(whole)
        return end

    def touched(self, after, upto) -> list[tuple]:
        """Row groups with positions in (after, upto], those that begin first at the front."""
        for path in log_files(self.folder):
            if path not in self.groups:
                self.groups[path] = self.bounds(path)
        every = [(*g[:2], path, g[2]) for path, some in self.groups.items() for g in some]
        return sorted(g for g in every if (after is None or g[1] > after) and (upto is None or g[0] <= upto))

    def bounds(self, path: str) -> list[tuple]:
        """Lowest and highest position of each row group, from the footer where it has them."""
        file, out = self.opened(path), []
        place = file.schema_arrow.get_field_index(self.column)
        for number in range(file.metadata.num_row_groups if place >= 0 else 0):
            chunk = next(c for c in map(file.metadata.row_group(number).column, range(file.metadata.num_columns)) if c.path_in_schema == self.column)
            known = chunk.statistics
            if known is not None and known.has_min_max and not isinstance(known.min, (str, bytes)):  # long texts may be cut in a footer
                low, high = known.min, known.max
            else:
                low, high = pc.min_max(file.read_row_group(number, columns=[self.column]).column(0)).as_py().values()
            if low is not None:
                out.append((low, high, number))
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        """One task for each row group touched. A restart calls this with an empty stretch, which tells the position."""
        after, upto = start.get("position"), end.get("position")
        self.at = upto
        if after == upto:
            return []
        return [Stretch(path, number, after, upto) for _, _, path, number in self.touched(after, upto)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        file = self.opened(partition.path)
        present = set(file.schema_arrow.names)
        wanted = [n for n in dict.fromkeys([self.column, *self.names]) if n in present]
        for batch in file.iter_batches(ROWS, row_groups=[partition.group], columns=wanted):
            position = batch.column(batch.schema.get_field_index(self.column))
            inside = pc.less_equal(position, partition.upto)
            if partition.after is not None:
                inside = pc.and_(inside, pc.greater(position, partition.after))
            kept = batch.filter(inside)  # null positions fall out
            arrays = [kept.column(kept.schema.get_field_index(n)).cast(t) if n in present else pa.nulls(kept.num_rows, t) for n, t in zip(self.names, self.types)]
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).types


class PositionSource(DataSource):
    """``format("positions")`` with the options ``path``, ``position`` (a whole-number or text column), ``maxChanges`` and ``stretches``."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def streamReader(self, schema: StructType) -> PositionReader:
        return PositionReader({k.lower(): v for k, v in self.options.items()}, schema)


def position_stream(spark: SparkSession, folder: str, schema: StructType | str, position: str, most: int = BATCH, stretches: int = 1) -> DataFrame:
    """Changes in stretches of positions, at most so many in one unless one position has more, and so many stretches in a batch."""
    spark.dataSource.register(PositionSource)
    return spark.readStream.format("positions").schema(schema).option("position", position).option("maxChanges", most).option("stretches", stretches).load(folder)


def capture(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes everything there is now, batch after batch, and stops; each batch has its own folder, so a repeated one replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
