"""A feed of several tables against a plain loop over its lines."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest

from conftest import rows
from evenkeel.operators import envelope as en
from evenkeel.operators.replay import Policy, ReplayConflict

SCHEMAS = {"a": "id long, n decimal(9,2), note string", "b": "x int, y string, seen timestamp_ntz"}
KEYS = {"a": ("id",), "b": ("x", "y")}


def targets(spark, a=(), b=(), policies=None):
    policies = policies or {}
    data = {"a": a, "b": b}
    return {t: en.Target(spark.createDataFrame(list(data[t]), SCHEMAS[t]), KEYS[t], policies.get(t, Policy())) for t in SCHEMAS}


def feed(spark, lines):
    return spark.createDataFrame([(x, n) for n, x in enumerate(lines)], "value string, nr long")


def counted(done):
    return {(r["table"], r["outcome"]): r["changes"] for r in done.counts.collect()}


def loop(start, changes):
    state = {t: dict(rows) for t, rows in start.items()}
    count = Counter()
    for c in sorted(changes, key=lambda c: (c["scn"], c["nr"])):
        t, data = c["table"], c.get("data", {})
        key = tuple((data if c["operation"] == "INSERT" else c["pk"])[k] for k in KEYS[t])
        rest = [f.split()[0] for f in SCHEMAS[t].split(", ") if f.split()[0] not in KEYS[t]]
        there = key in state[t]
        if c["operation"] == "INSERT" and not there:
            state[t][key] = {f: data.get(f) for f in rest}
            count[t, "inserted"] += 1
        elif c["operation"] == "INSERT":
            count[t, "conflict_skipped"] += 1
        elif not there:
            count[t, "missing_skipped"] += 1
        elif c["operation"] == "UPDATE":
            state[t][key].update({f: data[f] for f in rest if f in data})
            count[t, "updated"] += 1
        else:
            del state[t][key]
            count[t, "deleted"] += 1
    return state, count


def test_two_tables_against_a_loop(spark):
    rnd = random.Random(5)
    changes = []
    for nr in range(400):
        t = rnd.choice("ab")
        op = rnd.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        if t == "a":
            pk = {"id": 0 if rnd.random() < 0.4 else rnd.randrange(6)}
            data = {k: v for k, v in (("n", rnd.choice([None, rnd.randrange(9) + 0.25])), ("note", rnd.choice([None, "", "é'\"\\"]))) if rnd.random() < 0.6}
        else:
            pk = {"x": rnd.randrange(2), "y": rnd.choice("pq")}
            data = {k: v for k, v in (("seen", rnd.choice([None, "2024-01-02 03:04:05"])),) if rnd.random() < 0.6}
        c = {"operation": op, "table": t, "scn": nr // 3, "nr": nr, "timestamp": "2024-01-01T00:00:00Z", "pk": pk}
        if op != "DELETE":
            c["data"] = {**data, **(pk if op == "INSERT" else {}), "unknown": [1]}
        changes.append(c)
    lines = [json.dumps(c) for c in changes]
    shuffled = [(x, n) for n, x in enumerate(lines)] + [(lines[7], 7), (lines[90], 90)]  # two delivered again
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "value string, nr long")
    done = en.replay_envelopes(df, targets(spark, a=[(0, Decimal("1.00"), "old"), (77, None, None)]), place="nr")
    state, count = loop({"a": {(0,): {"n": 1.0, "note": "old"}, (77,): {"n": None, "note": None}}, "b": {}}, changes)
    number = lambda v: None if v is None else Decimal(str(v)).quantize(Decimal("0.01"))
    time = lambda v: None if v is None else dt.datetime.fromisoformat(v)
    assert rows(done.tables["a"]) == sorted([(*k, number(v["n"]), v["note"]) for k, v in state["a"].items()], key=repr)
    assert rows(done.tables["b"]) == sorted([(*k, time(v["seen"])) for k, v in state["b"].items()], key=repr)
    assert counted(done) == dict(count)
    assert done.rejected.isEmpty()


def test_rejected_lines_keep_text_and_reason(spark):
    def change(**kw):
        base = {"operation": "INSERT", "table": "a", "scn": 1, "data": {"id": 1}}
        return json.dumps({k: v for k, v in {**base, **kw}.items() if v is not ...})

    bad = {
        None: "bad json",
        "": "bad json",
        "{": "bad json",
        "[]": "unknown operation",
        "null": "unknown operation",
        change(operation="TRUNCATE"): "unknown operation",
        change(table="nowhere"): "unknown table",
        change(table=...): "unknown table",
        change(scn="later"): "no position",
        change(data={"n": 5}): "no key: id",
        change(data=..., pk=...): "no key: id",
        change(data={"id": None}): "no key: id",
        change(data={"id": "one"}): "bad value: id",
        change(data={"id": 2, "n": "much"}): "bad value: n",
        change(operation="UPDATE", pk={"id": 5}, data={"n": {"of": 1}}): "bad value: n",
        change(operation="DELETE"): "no key: id",
    }
    good = [change(), change(operation="delete", pk={"id": 9}, data={"n": "much"}), change(data=..., pk={"id": 3}, scn=2)]
    done = en.replay_envelopes(feed(spark, [*bad, *good]), targets(spark, a=[(9, None, "x")]), place="nr")
    assert {r["raw"]: r["reason"] for r in done.rejected.collect()} == bad
    assert rows(done.tables["a"], "id") == [(1,), (3,)]
    assert counted(done)["a", "rejected"] == 9 and counted(done)["a", "deleted"] == 1


def test_own_columns_named_like_the_envelope(spark):
    rows_ = spark.createDataFrame([(1, "x", 5, "r")], "scn long, op string, place int, raw string")
    target = {"t": en.Target(rows_, ("scn",))}
    lines = [json.dumps({"operation": "UPDATE", "table": "t", "scn": 4, "pk": {"scn": 1}, "data": {"op": "U2", "raw": None}})]
    assert rows(en.replay_envelopes(feed(spark, lines), target).tables["t"]) == [(1, "U2", 5, None)]


def test_empty_feed_and_abort(spark):
    done = en.replay_envelopes(feed(spark, []), targets(spark, a=[(1, None, "x")]), place="nr")
    assert rows(done.tables["a"]) == [(1, None, "x")] and done.rejected.isEmpty() and done.counts.isEmpty()
    line = json.dumps({"operation": "DELETE", "table": "a", "scn": 4, "pk": {"id": 2}})
    with pytest.raises(ReplayConflict):
        en.replay_envelopes(feed(spark, [line]), targets(spark, policies={"a": Policy(on_missing="ABORT")}), place="nr")


def test_changes_are_parsed_once(spark):
    line = {"operation": "INSERT", "table": "a", "scn": 1, "data": {"id": 1, "n": 2}}
    done = en.replay_envelopes(feed(spark, [json.dumps(line)]), targets(spark), place="nr")
    for df in (*done.tables.values(), done.counts, done.rejected):
        assert "variant_get" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert counted(done) == {("a", "inserted"): 1}
