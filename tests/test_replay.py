"""Ordered replay against a plain loop over the changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evenkeel.operators import replay as rp
from evenkeel.operators.remediate import merge_delta
from evenkeel.streaming import changes as sc, health as sh
from evenkeel.streaming.state import KeyedState

TARGET = "pk long, a long, b string"
CHANGE = "pk long, seq long, op string, a long, b string, cols array<string>"


def feed(n=400, seed=0, ops="IIUUUDX", keys=9):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        # one key takes a third of all changes
        pk = 0 if rnd.random() < 0.34 else rnd.randrange(keys)
        cols = rnd.choice([["a"], ["b"], ["a", "b"], []])
        out.append((pk, seq * 3 + 1, rnd.choice(ops), rnd.choice([None, rnd.randrange(100)]), rnd.choice([None, "x", "y"]), cols))
    return out


def loop(target, changes, conflict="SKIP", partial=True):
    """Row-at-a-time meaning of the replay."""
    state = {pk: {"a": a, "b": b} for pk, a, b in target}
    outcome = {}

    def mark(o):
        outcome[o] = outcome.get(o, 0) + 1

    for pk, _, op, a, b, cols in sorted(changes, key=lambda c: c[1]):
        carried = cols if partial else ["a", "b"]
        values = {c: v for c, v in (("a", a), ("b", b)) if c in carried}
        if op == "I":
            if pk not in state:
                state[pk] = {"a": None, "b": None, **values}
                mark("inserted")
            elif conflict == "UPSERT":
                state[pk].update(values)
                mark("upserted")
            else:
                mark("conflict_skipped")
        elif op == "U":
            if pk in state:
                state[pk].update(values)
                mark("updated")
            else:
                mark("missing_skipped")
        elif op == "D":
            mark("deleted" if state.pop(pk, None) is not None else "missing_skipped")
        else:
            mark("unknown_op")
    return sorted(((k, v["a"], v["b"]) for k, v in state.items()), key=repr), outcome


BASE = [(0, 1, "base"), (3, None, "base"), (99, 7, "untouched")]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("conflict", ["SKIP", "UPSERT"])
@pytest.mark.parametrize("partial", [True, False])
def test_replay_matches_loop(spark, seed, conflict, partial):
    c = feed(seed=seed)
    target, changes = spark.createDataFrame(BASE, TARGET), spark.createDataFrame(c, CHANGE).repartition(4)
    want, outcome = loop(BASE, c, conflict, partial)
    policy = rp.Policy(conflict)
    got = rp.replay(target, changes, ["pk"], policy=policy, carried="cols" if partial else None)
    assert rows(got, "pk", "a", "b") == want
    assert dict(rows(rp.replay_outcomes(target, changes, ["pk"], policy=policy))) == outcome


def test_abort_policies_raise(spark):
    target = spark.createDataFrame(BASE, TARGET)
    dup = spark.createDataFrame([(0, 1, "I", 5, "x", [])], CHANGE)
    gone = spark.createDataFrame([(50, 1, "U", 5, "x", [])], CHANGE)
    with pytest.raises(rp.ReplayConflict):
        rp.replay(target, dup, ["pk"], policy=rp.Policy("ABORT"))
    with pytest.raises(rp.ReplayConflict):
        rp.replay(target, gone, ["pk"], policy=rp.Policy("SKIP", "ABORT"))
    assert rp.replay(target, gone, ["pk"]).count() == 3


def test_upsert_ignores_operations(spark):
    c = feed(seed=7, ops="IUD")
    got = rp.replay_upsert(spark.createDataFrame(BASE, TARGET), spark.createDataFrame(c, CHANGE), ["pk"], carried="cols")
    state = {pk: {"a": a, "b": b} for pk, a, b in BASE}
    for pk, _, _, a, b, cols in c:
        row = state.setdefault(pk, {"a": None, "b": None})
        row.update({k: v for k, v in (("a", a), ("b", b)) if k in cols})
    assert rows(got, "pk", "a", "b") == sorted(((k, v["a"], v["b"]) for k, v in state.items()), key=repr)


def test_coded_changes(spark):
    data = [
        (1, 10, 2, 5, "x", ["a", "b"]),
        (1, 20, 3, 5, "x", ["a", "b"]),
        (1, 20, 4, 6, "y", ["a"]),
        (1, 30, 4, 0, "z", ["pk"]),
        (None, 40, 2, 1, "n", ["a", "b"]),
        (0, 50, 1, None, None, []),
        (2, 60, 9, 1, "s", ["a", "b"]),
    ]
    changes = spark.createDataFrame(data, "pk long, seq long, code int, a long, b string, cols array<string>")
    got = rp.replay_coded(spark.createDataFrame(BASE, TARGET), changes, "pk", carried="cols")
    assert rows(got, "pk", "a", "b") == [(1, 6, "x"), (3, None, "base"), (99, 7, "untouched")]


def test_merge_delta_forms(spark):
    target = spark.createDataFrame(BASE, TARGET)
    delta = spark.createDataFrame([(0, "D", None, None), (3, "I", 4, "i"), (5, "U", 6, "u"), (6, "D", None, None)], "pk long, op_type string, a long, b string")
    assert rows(merge_delta(target, delta, "pk"), "pk", "a", "b") == [(3, 4, "i"), (5, 6, "u"), (99, 7, "untouched")]
    kept = merge_delta(target, delta, "pk", with_deletes=False)
    assert rows(kept, "pk") == [(0,), (3,), (5,), (99,)]


def test_stream_in_many_batches_equals_one_replay(spark, tmp_path):
    c = feed(n=120, seed=5, ops="IUD")
    src = str(tmp_path / "in")
    schema = "pk long, seq long, op string, a long, b string, ts timestamp, table string"
    for part in range(6):
        chunk = [(pk, seq, op, a, b) for pk, seq, op, a, b, _ in c[part * 20 : part * 20 + 20]]
        d = spark.createDataFrame(chunk, "pk long, seq long, op string, a long, b string")
        d.withColumn("ts", F.timestamp_seconds("seq")).withColumn("table", F.lit("t")).coalesce(1).write.mode("append").json(src)
    state = KeyedState(spark, str(tmp_path / "state"), ["pk"], TARGET, per_generation=2)
    marks = KeyedState(spark, str(tmp_path / "marks"), ["table"], "table string, last_seq long, last_timestamp timestamp, rows_applied long", per_generation=2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    sc.replay_stream(stream, state, marks, str(tmp_path / "ck"))
    want, _ = loop([], c, "SKIP", partial=False)
    assert rows(state.latest(), "pk", "a", "b") == want
    assert marks.latest().first().rows_applied == 120
    # started again with the same checkpoint, there is nothing left to do
    sc.replay_stream(spark.readStream.schema(schema).json(src), state, marks, str(tmp_path / "ck"))
    assert rows(state.latest(), "pk", "a", "b") == want


def test_applied_changes_are_skipped(spark):
    c = spark.createDataFrame(feed(n=50, seed=2), CHANGE).withColumn("t", F.lit("x")).withColumn("ts", F.timestamp_seconds("seq"))
    half = c.where("seq < 70")
    mark = rp.checkpoint_of(half, "t", "seq", "ts")
    rest = rp.skip_applied(c.unionByName(c), mark, "t", "seq")
    assert rows(rest, "seq") == rows(c.where("seq >= 70"), "seq")
    assert rp.skip_applied(c, rp.checkpoint_of(c, "t", "seq", "ts"), "t", "seq").count() == 0
    assert rp.skip_applied(c, mark, "t", "seq", restart=True).count() == 50


def test_changes_that_share_a_position_all_stay(spark):
    c = spark.createDataFrame([("t", 10, k, "I") for k in (1, 2, 3)] + [("t", 10, 3, "I"), ("t", 4, 9, "U")], "tab string, seq long, pk long, op string")
    mark = spark.createDataFrame([("t", 5)], "tab string, last_seq long")
    assert rows(rp.skip_applied(c, mark, "tab", "seq"), "pk") == [(1,), (2,), (3,)]
    pairs = c.withColumn("pos", F.struct(F.col("seq").alias("lsn"), F.col("pk").alias("seqval"))).drop("seq")
    mark = spark.createDataFrame([("t", (10, 1))], "tab string, last_seq struct<lsn:long,seqval:long>")
    assert rows(rp.skip_applied(pairs, mark, "tab", "pos"), "pk") == [(2,), (3,)]


def test_interleaved_files_lose_no_change(spark, tmp_path):
    """Two files with positions {5, 9} and {7, 9, 10}; one change is behind its own key."""
    schema = "table string, seq long, ts timestamp, pk long, op string, a long"
    when = dt.datetime(2024, 1, 1)
    files = [[(5, 1, "I", 1), (9, 2, "I", 2)], [(7, 3, "I", 3), (9, 4, "I", 4), (10, 1, "U", 9), (8, 2, "U", 0), (11, 8, "D", 0)]]
    for part in files:  # one file after the other, so their times differ
        spark.createDataFrame([("t", s, when, k, o, a) for s, k, o, a in part], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    state = KeyedState(spark, str(tmp_path / "state"), ["pk"], "pk long, a long")
    marks = KeyedState(spark, str(tmp_path / "marks"), ["table"], "table string, last_seq long, last_timestamp timestamp, rows_applied long")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sc.replay_stream(feed, state, marks, str(tmp_path / "ck"), dead=str(tmp_path / "dead"))
    assert rows(state.latest(), "pk", "a") == [(1, 9), (2, 2), (3, 3), (4, 4)]
    failed = spark.read.json(str(tmp_path / "dead"))
    assert rows(failed, "pk", "reject_reason") == [(2, "behind the key's last position"), (8, "missing_skipped")]


def test_heartbeat_stream_carries_streaks(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    oks = [True, False, False, False, True, False, False, False, False]
    for i, ok in enumerate(oks):
        d = spark.createDataFrame([(i, "db", ok)], "id long, target string, ok boolean").withColumn("ts", F.timestamp_seconds("id"))
        d.coalesce(1).write.mode("append").json(src)
    schema = "id long, target string, ok boolean, ts timestamp"
    sh.heartbeat_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(src), out, str(tmp_path / "ck"))
    got = rows(spark.read.parquet(out), "id", "streak", "alarm")
    assert [g[1] for g in got] == [0, 1, 2, 3, 0, 1, 2, 3, 4]
    assert [g[2] for g in got] == [s >= 3 for s in [0, 1, 2, 3, 0, 1, 2, 3, 4]]
    # more files after a restart: the streak goes on, and nothing comes twice
    d = spark.createDataFrame([(9, "db", False), (10, "db", None), (11, "other", False)], "id long, target string, ok boolean").withColumn("ts", F.timestamp_seconds("id"))
    d.coalesce(1).write.mode("append").json(src)
    sh.heartbeat_stream(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck"))
    assert rows(spark.read.parquet(out).where("id > 7"), "id", "streak") == [(10, 6), (11, 1), (8, 4), (9, 5)]


def test_stream_with_parts_of_rows_equals_one_replay(spark, tmp_path):
    """Changes that carry some columns, every policy but ABORT, several files and a restart."""
    c = feed(n=90, seed=8, ops="IUDX")
    schema = CHANGE + ", ts timestamp, table string"
    src = str(tmp_path / "in")
    for part in range(3):
        d = spark.createDataFrame(c[part * 30 : part * 30 + 30], CHANGE).withColumn("ts", F.timestamp_seconds("seq")).withColumn("table", F.lit("t"))
        d.coalesce(1).write.mode("append").json(src)
        for conflict in ("SKIP", "UPSERT"):
            state = KeyedState(spark, str(tmp_path / conflict / "state"), ["pk"], TARGET)
            marks = KeyedState(spark, str(tmp_path / conflict / "marks"), ["table"], "table string, last_seq long, last_timestamp timestamp, rows_applied long")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
            sc.replay_stream(stream, state, marks, str(tmp_path / conflict / "ck"), policy=rp.Policy(conflict), carried="cols")
            changes = spark.createDataFrame(c[: part * 30 + 30], CHANGE)
            want = rp.replay(spark.createDataFrame([], TARGET), changes, ["pk"], policy=rp.Policy(conflict), carried="cols")
            assert rows(state.latest(), "pk", "a", "b") == rows(want, "pk", "a", "b")


def test_a_stream_that_breaks_the_policy_stops(spark, tmp_path):
    d = spark.createDataFrame([(1, 5, "U", 1, "x", ["a"])], CHANGE).withColumn("ts", F.timestamp_seconds("seq")).withColumn("table", F.lit("t"))
    d.write.json(str(tmp_path / "in"))
    state = KeyedState(spark, str(tmp_path / "state"), ["pk"], TARGET)
    marks = KeyedState(spark, str(tmp_path / "marks"), ["table"], "table string, last_seq long, last_timestamp timestamp, rows_applied long")
    with pytest.raises(Exception, match="missing_abort"):
        sc.replay_stream(spark.readStream.schema(d.schema).json(str(tmp_path / "in")), state, marks, str(tmp_path / "ck"), policy=rp.Policy("ABORT", "ABORT"))
    assert state.latest().count() == 0


def test_state_removes_dead_keys_and_survives_repeats(spark, tmp_path):
    st = KeyedState(spark, str(tmp_path / "s"), ["k"], "k string, v long", per_generation=2)
    row = lambda *r: spark.createDataFrame(list(r), "k string, v long, alive boolean")
    st.write(0, row(("a", 1, True), ("b", 1, True)))
    st.write(1, row(("a", 2, True)))
    st.write(1, row(("a", 3, True)))
    st.write(2, row(("b", 0, False), ("c", 5, True)))
    assert rows(st.latest(), "k", "v") == [("a", 3), ("c", 5)]
    assert rows(st.before(2), "k", "v") == [("a", 3), ("b", 1)]
    assert rows(st.before(1), "k", "v") == [("a", 1), ("b", 1)]
    assert st.before(0).count() == 0


def test_intervals_show_holes_until_late_files_fill_them(spark):
    def batch(*positions):
        return spark.createDataFrame([("t", p) for p in positions] + [("u", 7), ("u", None)], "tab string, seq long")

    first = rp.position_intervals(batch(1, 2, 3, 3, 8), "tab", "seq")
    assert rows(first, "tab", "low", "high") == [("t", 1, 3), ("t", 8, 8), ("u", 7, 7)]
    jumped = rp.merge_intervals(first.unionByName(rp.position_intervals(batch(20, 21), "tab", "seq")), "tab")
    assert rows(rp.missing_positions(jumped, "tab"), "tab", "first_missing", "last_missing", "missing") == [("t", 4, 7, 4), ("t", 9, 19, 11)]
    late = rp.merge_intervals(jumped.unionByName(rp.position_intervals(batch(4, 5, 6, 7, 2, 9), "tab", "seq")), "tab")
    assert rows(late, "tab", "low", "high") == [("t", 1, 9), ("t", 20, 21), ("u", 7, 7)]
    inside = spark.createDataFrame([("t", 0, 100), ("t", 5, 6), ("t", 101, 102), ("t", 104, 104)], "tab string, low long, high long")
    assert rows(rp.merge_intervals(inside, "tab"), "low", "high") == [(0, 102), (104, 104)]


def test_tables_on_and_behind_a_cycle_have_no_level(spark):
    tables = spark.createDataFrame([(x,) for x in "abcdefg"], "name string")
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "d"), ("g", "g"), ("g", "g")], "name string, parent string")
    got = {r["name"]: (r["dependency_level"], r["in_order"]) for r in rp.dependency_levels(tables, links, "name", "parent").collect()}
    assert got == {"a": (0, True), "b": (1, True), "c": (2, True), "d": (None, False), "e": (None, False), "f": (None, False), "g": (0, True)}


def test_binary_positions_decide_part_by_part(spark):
    from evenkeel.functions.positions import composite

    feed = [("0a", "01", 2, 1, "in"), ("0a", "01", 3, 9, "old"), ("0a", "01", 4, 2, "up"), ("09", "ff", 2, 0, "first"), ("0a", "02", 1, 0, "x"), ("0a", "02", 2, 5, "again")]
    random.Random(1).shuffle(feed)
    df = spark.createDataFrame([(1, *f) for f in feed], "pk long, lsn string, seqval string, code int, a long, b string")
    placed = df.withColumn("position", composite("lsn", "seqval", "code")).drop("lsn", "seqval")
    assert rows(rp.replay_coded(spark.createDataFrame([], TARGET), placed, "pk", "position"), "pk", "a", "b") == [(1, 5, "again")]
