"""Sources and sinks on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evenkeel.operators.compare import compare_summaries, last_row_wins
from evenkeel.operators.formats import format_bench
from evenkeel.sources import readers as rd, writers as wr


def test_csv_uses_one_schema_for_all_rows(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("id,v\n" + "".join(f"{i},{i}.5\n" for i in range(20)) + "x,7.5\n")
    d = rd.read_csv(spark, str(f))
    assert [t for _, t in d.dtypes] == ["string", "double", "string"]
    assert d.where("id = 'x'").first()["v"] == 7.5
    given = rd.read_csv(spark, str(f), "id int, v double")
    assert given.where("_corrupt IS NOT NULL").first()["_corrupt"] == "x,7.5"
    assert d.count() == 21


def test_csv_folder_goes_on_after_a_bad_file(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n")
    (tmp_path / "more.csv").write_text("c\n5\n6\n")
    (tmp_path / "note.txt").write_text("not a table")
    (tmp_path / "bad.csv").write_text("")
    tables, failed = rd.read_csv_dir(spark, str(tmp_path))
    assert {"good", "more"} <= set(tables) and "note" not in tables
    assert rows(tables["more"], "c") == [(5,), (6,)]
    assert all("bad" in p for p, _ in failed)
    counts = {r.path.rsplit("/", 1)[1]: r.row_count for r in rd.rows_per_file(spark, str(tmp_path)).collect()}
    assert counts["good.csv"] == 1 and counts["more.csv"] == 2


def test_queue_keeps_broken_lines_apart(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"seq":1,"op":"I"}\n\n{"seq":2,"op"\n   \n{"seq":"three"}\n{"seq":4}\n')
    d = rd.read_change_queue(spark, str(tmp_path), "seq long, op string")
    assert rows(d.where("_corrupt IS NULL"), "seq", "op") == [(1, "I"), (4, None)]
    assert d.where("_corrupt IS NOT NULL").count() == 2
    wr.write_dead_letter(d.where("_corrupt IS NOT NULL"), str(tmp_path / "dead"), "invalid JSON")
    assert spark.read.json(str(tmp_path / "dead")).count() == 2


def test_summary_numbers(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("schema_name,table_name,row_count,hash_sum,updated_count,deleted_count,run_ts\ns,t,12.9,ab,,-3.7,z\ns,t,7,cd,1,x,z\ns,u,1,,0,0,z\n")
    d = rd.read_summary(spark, str(f))
    assert rows(d, "table_name", "row_count", "hash_sum", "updated_count", "deleted_count") == [("t", 12, "ab", 0, -3), ("t", 7, "cd", 1, 0), ("u", 1, "", 0, 0)]
    last = last_row_wins(d, ["schema_name", "table_name"], "pos")
    assert rows(last, "table_name", "row_count") == [("t", 7), ("u", 1)]
    assert {r.severity for r in compare_summaries(last, last).collect()} == {"OK"}


def test_json_arrays(spark, tmp_path):
    (tmp_path / "posts.json").write_text(json.dumps([{"id": 1, "title": "a\nb"}, {"id": 2, "title": "c"}], indent=4))
    assert rows(rd.read_json(spark, str(tmp_path / "posts.json")), "id", "title") == [(1, "a\nb"), (2, "c")]
    d = spark.range(0, 25, 1, 4).select("id", F.concat(F.lit('q"\n'), "id").alias("s"))
    wr.write_json_array(d.where("id < 13"), str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        json.loads(part.read_text())
    assert rows(rd.read_json(spark, str(tmp_path / "out"), "id long, s string")) == rows(d.where("id < 13"))


def test_jdbc_options():
    o = rd.jdbc_options("jdbc:x", "t", "id", (1, 100), 8)
    assert o == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "8"}
    assert "partitionColumn" not in rd.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        rd.jdbc_options("jdbc:x", "t", "id")


def test_rows(spark):
    assert rows(rd.from_rows(spark, [(1, "a")], "i int, s string")) == [(1, "a")]
    assert rd.generated_rows(spark, 5, sq=F.col("id") * F.col("id")).agg(F.sum("sq")).first()[0] == 30


def test_manifest_finds_every_fault(spark, tmp_path):
    good = str(tmp_path / "a")
    spark.range(100).repartition(4).write.parquet(good)
    m = rd.build_manifest(spark, good, "t", 7)
    assert rows(rd.verify_manifest(m, m), "status") == [("OK",)] * 4
    chunks = sorted(r.chunk_id for r in m.collect())
    broken = m.where(F.col("chunk_id") != chunks[0]).withColumn("checksum_sha256", F.when(F.col("chunk_id") == chunks[1], "0").otherwise(F.col("checksum_sha256")))
    broken = broken.withColumn("file_size_bytes", F.when(F.col("chunk_id") == chunks[2], 1).otherwise(F.col("file_size_bytes")))
    extra = broken.unionByName(m.where(F.col("chunk_id") == chunks[3]).withColumn("chunk_id", F.lit("new")))
    got = dict(rows(rd.verify_manifest(m, extra), "chunk_id", "status"))
    assert got == {chunks[0]: "MISSING", chunks[1]: "CHECKSUM", chunks[2]: "SIZE", chunks[3]: "OK", "new": "UNEXPECTED"}
    assert rd.manifest_with_rows(m, spark.read.parquet(good)).agg(F.sum("row_count")).first()[0] == 100


def test_parquet_codecs(spark, tmp_path):
    for codec in wr.CODECS:
        wr.write_parquet(spark.range(10), str(tmp_path / codec), codec, rows_per_file=4)
        assert spark.read.parquet(str(tmp_path / codec)).count() == 10
    with pytest.raises(ValueError, match="brotli"):
        wr.write_parquet(spark.range(10), str(tmp_path / "b"), "brotli")


def test_snapshots_replace_only_their_own_run_and_role(spark, tmp_path):
    path = str(tmp_path / "snap")
    one = lambda v: spark.createDataFrame([("t", v)], "table_name string, v int")
    wr.save_snapshot(one(1), path, "r1", "SOURCE")
    wr.save_snapshot(one(2), path, "r1", "TARGET")
    wr.save_snapshot(one(3), path, "r1", "SOURCE")
    wr.save_snapshot(one(4), path, "r2", "SOURCE")
    assert rows(spark.read.parquet(path), "run_id", "role_name", "v") == [("r1", "SOURCE", 3), ("r1", "TARGET", 2), ("r2", "SOURCE", 4)]


def test_formats_report_what_is_missing(spark, tmp_path):
    out = {r.format: r for r in format_bench(spark.range(1000), str(tmp_path / "f"), "id", ["parquet", "csv", "avro"]).collect()}
    assert out["parquet"].available and out["parquet"].relative_size == 1.0 and out["csv"].bytes > 0
    assert not out["avro"].available and out["avro"].note


def test_report_files_are_in_report_order(spark, tmp_path):
    d = spark.range(0, 500, 1, 6).select((F.col("id") * 37 % 101).alias("n"), "id")
    wr.write_csv_report(d, str(tmp_path / "r"), ["id", "n"], order_by=[F.desc("n"), F.asc("id")])
    lines = [x for p in sorted((tmp_path / "r").glob("part-*")) for x in p.read_text().splitlines() if x != "id,n"]
    assert lines == [f"{i},{n}" for n, i in sorted(((i * 37 % 101, i) for i in range(500)), key=lambda x: (-x[0], x[1]))]


def test_manifest_file(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text(
        "table_name,chunk_id,export_start_ts,export_end_ts,anchor_scn,row_count,file_size_bytes,checksum_sha256,source_path,databox_path,status\n"
        "t,c1,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,7,10,100,abc,/a,/b,DONE\n"
    )
    r = rd.read_manifest(spark, str(f)).first()
    assert (r.chunk_id, r.anchor_scn, r.row_count, r.file_size_bytes, r.status) == ("c1", 7, 10, 100, "DONE")


def test_folder_conversion_reports_bad_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,note\n1,\"two\nlines\"\n3000000000,b\n")
    (tmp_path / "empty.csv").write_text("")
    done = {r["stem"]: r for r in wr.convert_csv_folder(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert done["empty"]["error"] and done["empty"]["rows_read"] is None
    assert done["good"]["error"] is None and done["good"]["bad_rows"] == 0


def test_quoted_line_breaks_start_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,b\n')
    assert [r["row_count"] for r in rd.rows_per_file(spark, str(tmp_path)).collect()] == [2]


def test_bad_values_are_never_silent(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text("id,amount\n1,2.5\n2,n/a\n")
    with pytest.raises(ValueError, match="1 of 2 rows"):
        wr.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), schema="id int, amount double")
    done = wr.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "q"), schema="id int, amount double", quarantine=str(tmp_path / "bad"))
    assert tuple(done.first()) == (2, 1, 1)
    assert spark.read.json(str(tmp_path / "bad")).first()["_corrupt"] == "2,n/a"


def test_format_bench_with_codecs(spark, tmp_path):
    plain, packed = ({r.format: r for r in format_bench(spark.range(5000), str(tmp_path / n), "id", ["csv", "json"], codecs).collect()} for n, codecs in (("p", None), ("z", {"json": "gzip"})))
    assert [(r.row_count, int(r.total)) for r in packed.values()] == [(5000, 12497500)] * 2
    assert packed["json"].bytes < plain["json"].bytes / 2 and packed["csv"].bytes == plain["csv"].bytes


def test_format_bench_holds_one_format_at_a_time(spark, tmp_path, monkeypatch):
    from evenkeel.operators import formats

    df = spark.range(0, 5000, 1, 3)
    kept, freed, held, release = tmp_path / "k", tmp_path / "f", [], formats.release

    def watched(session, path):
        held.append((sorted(p.name for p in freed.iterdir()), len(list(freed.rglob("part-*")))))
        release(session, path)

    monkeypatch.setattr(formats, "release", watched)
    known = [[(r.format, r.available, r.bytes, r.row_count, r.total, r.relative_size) for r in format_bench(df, str(f), "id", keep=keep).collect()] for f, keep in ((kept, True), (freed, False))]
    assert known[0] == known[1] and [r[3] for r in known[1]] == [5000] * 4
    assert held == [([name], 3) for name in formats.FORMATS]
    assert len(list(kept.rglob("part-*"))) == 12 and not list(freed.iterdir())


def test_format_bench_leaves_what_it_did_not_write(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "mine").write_text("x")
    out = {r.format: r.available for r in format_bench(spark.range(10), str(tmp_path), "id", ["csv", "json"], keep=False).collect()}
    assert out == {"csv": False, "json": True} and [p.name for p in tmp_path.rglob("*")] == ["csv", "mine"]


def test_format_queries_leave_no_files(spark, tmp_path, monkeypatch):
    from evenkeel.plans import source_queries as sq
    from evenkeel.plans.registry import Tables

    spark.range(300).select(F.col("id").cast("double").alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(sq, "scratch_path", lambda s, name: str(tmp_path / "scratch" / name))
    for run in (sq.formats, sq.format_totals):
        assert [r.row_count for r in run(Tables(spark, str(tmp_path))).collect()] == [300] * 4
        assert not list((tmp_path / "scratch").rglob("*part-*"))


def test_pane_stream_takes_many_files_a_batch(spark, monkeypatch):
    from evenkeel.plans import source_queries as sq
    from evenkeel.plans.registry import Tables

    runs, run = [], sq.sh.upsert_windows
    monkeypatch.setattr(sq.sh, "upsert_windows", lambda *a: runs.append(run(*a)) or runs[-1])
    places, place = {}, sq.scratch_path
    monkeypatch.setattr(sq, "scratch_path", lambda s, name: places.setdefault(name, place(s, name)))
    sq.streamed_metrics(Tables(spark, "/root/testdata/sf0.001"))
    cores = spark.sparkContext.defaultParallelism
    files = spark.read.parquet(places["samples"]).select(F.input_file_name()).distinct().count()
    assert files == 4 * cores and len([p for p in runs[0].recentProgress if p["numInputRows"]]) == 4
