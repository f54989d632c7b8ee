"""The polling source: stretches of positions, restarts, awkward logs."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evenkeel.streaming.positions import PositionReader, capture, position_stream

SCHEMA = "scn long, pk long, note string"


def write(folder, name, rows, group=4, **options):
    folder.mkdir(exist_ok=True)
    columns = {"scn": pa.array([r[0] for r in rows], pa.int64()), "pk": pa.array([r[1] for r in rows], pa.int64())}
    if rows and len(rows[0]) > 2:
        columns["note"] = pa.array([r[2] for r in rows], pa.string())
    pq.write_table(pa.table(columns), folder / f"{name}.parquet", row_group_size=group, **options)


def taken(spark, out):
    return sorted((r["batch_id"], r["scn"], r["pk"]) for r in spark.read.parquet(out).collect())


def test_stretches_ties_and_restart(spark, tmp_path):
    log, out, ck = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    first = [(k // 3, k) for k in range(30)]  # three changes a commit
    write(log, "b", first[::2])  # both files hold all commits
    write(log, "a", [*first[1::2], (None, 99)])
    stream = lambda: position_stream(spark, str(log), SCHEMA, "scn", 7)
    capture(stream(), out, ck)
    rows = taken(spark, out)
    assert sorted(r[1:] for r in rows) == first
    per_batch = {b: [r for r in rows if r[0] == b] for b, _, _ in rows}
    assert [len(per_batch[b]) for b in sorted(per_batch)] == [6, 6, 6, 6, 6]  # a seventh would tear a commit
    more = [(50 + k // 20, 100 + k, "n") for k in range(25)]
    write(log, "c", more)
    write(log, "d", [(3, 1000)])  # a position that was passed
    capture(stream(), out, ck)
    rows = taken(spark, out)
    assert sorted(r[1:] for r in rows) == first + [m[:2] for m in more]
    last = [len([r for r in rows if r[0] == b]) for b in sorted({r[0] for r in rows})][5:]
    assert last == [20, 5]  # one commit is larger than the limit and comes whole
    notes = {r["pk"]: r["note"] for r in spark.read.parquet(out).collect()}
    assert notes[0] is None and notes[100] == "n"
    capture(stream(), out, ck)
    assert taken(spark, out) == rows


def test_log_without_changes_and_later_ones(spark, tmp_path):
    log, out, ck = tmp_path / "none", str(tmp_path / "out"), str(tmp_path / "ck")
    stream = lambda: position_stream(spark, str(log), SCHEMA, "scn", 2)
    capture(stream(), out, ck)
    write(log, "_partial", [(1, 1)])
    write(log, "empty", [])
    write(log, "nulls", [(None, 5)])
    capture(stream(), out, ck)
    write(log, "x", [(0, 7), (-4, 8)])
    capture(stream(), out, ck)
    assert [r[1:] for r in taken(spark, out)] == [(-4, 8), (0, 7)]


@pytest.mark.parametrize("statistics", [True, False])
def test_batch_end_reads_the_next_row_groups_only(tmp_path, statistics):
    from pyspark.sql.types import StructType

    log = tmp_path / "log"
    for k in range(5):
        write(log, f"f{k}", [(100 * k + j, j) for j in range(100)], group=10, write_statistics=statistics)
    reader = PositionReader({"path": str(log), "position": "scn", "maxchanges": "25"}, StructType.fromDDL(SCHEMA))
    reader.partitions({"position": 209}, {"position": 209})  # what a restart does
    read = []
    opened = reader.opened

    class Counting:
        def __init__(self, path):
            self.file, self.path = opened(path), path

        def read_row_group(self, number, columns):
            read.append((self.path[-10:], number))
            return self.file.read_row_group(number, columns=columns)

        def __getattr__(self, name):
            return getattr(self.file, name)

    reader.opened = Counting
    reader.touched(None, None)
    read.clear()
    assert reader.latestOffset() == {"position": 234}
    assert read == [("f2.parquet", k) for k in (1, 2, 3)]
    assert [(p.path[-10:], p.group) for p in reader.partitions({"position": 209}, {"position": 234})] == read
    assert reader.latestOffset() == {"position": 259}


def test_text_positions(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lsn = [f"{k:020x}" for k in range(40)]
    pq.write_table(pa.table({"lsn": lsn[20:] + lsn[:20], "pk": list(range(40))}), log / "a.parquet", row_group_size=8)
    out = str(tmp_path / "out")
    capture(position_stream(spark, str(log), "lsn string, pk long", "lsn", 15), out, str(tmp_path / "ck"))
    rows = spark.read.parquet(out).collect()
    assert sorted(r["lsn"] for r in rows) == lsn
    assert sorted(max(r["lsn"] for r in rows if r["batch_id"] == b) for b in range(3)) == [lsn[14], lsn[29], lsn[39]]


def test_batches_of_several_stretches(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    commits = [(k // 3, k) for k in range(60)] + [(30, 100 + k) for k in range(9)] + [(40, 200)]  # three changes a commit, then one of nine
    write(log, "b", commits[::2])
    write(log, "a", [*commits[1::2], (None, 99)])
    capture(position_stream(spark, str(log), SCHEMA, "scn", 7, stretches=3), out, str(tmp_path / "ck"))
    rows = taken(spark, out)
    assert sorted(r[1:] for r in rows) == commits
    # stretches of two commits, three in a batch; the large commit ends a batch before it and has its own
    assert [sum(r[0] == b for r in rows) for b in sorted({r[0] for r in rows})] == [18, 18, 18, 6, 9, 1]
