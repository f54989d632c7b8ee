"""Segmented running values against plain Python loops, with a hot key, null keys and ties."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evenkeel.functions import segments as sg
from evenkeel.operators import ordered

SCHEMA = "id long, k string, ts timestamp, v long, ok boolean"


def sample(n=600, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(400))
        out.append((i, key, ts, rnd.randrange(-50, 50), rnd.random() > 0.5))
    return out


@pytest.fixture(scope="module")
def data():
    return sample()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_segments_are_many_and_monotone(frame):
    layout = sg.find_layout(frame, ["k"], "ts")
    assert [r[0]["k"] for r in layout.hot.collect()] and not layout.plain
    d = layout.attach(frame).where("k = 'hot'")
    assert d.select(sg.SEGMENT).distinct().count() > 20
    worst = d.groupBy(sg.SEGMENT).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy(sg.SEGMENT).collect()
    assert all(a.hi < b.lo for a, b in zip(worst, worst[1:]))


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_matches_loop(frame, data, exclusive):
    out = sg.running(
        frame, ["k"], ["ts", "id"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.when(F.col("ok"), F.col("v")))}, exclusive, {"all": ("sum", F.lit(1))}
    )
    want = []
    for key, group in by_key(data).items():
        for i, r in enumerate(group):
            part = group[: i if exclusive else i + 1]
            oks = [x[3] for x in part if x[4]]
            want.append((r[0], sum(x[3] for x in part) if part else None, max((x[3] for x in part), default=None), min(oks, default=None), len(group)))
    assert rows(out, "id", "s", "hi", "lo", "all") == sorted(want, key=repr)


def test_lagged_matches_loop(frame, data):
    out = sg.lagged(frame, ["k"], ["ts", "id"], {"prev": F.col("v")})
    want = [(r[0], g[i - 1][3] if i else None) for g in by_key(data).values() for i, r in enumerate(g)]
    assert rows(out, "id", "prev") == sorted(want, key=repr)


def test_no_key_is_one_sequence(frame, data):
    out = sg.running(frame, [], ["ts", "id"], {"n": ("sum", F.lit(1))})
    want = [(r[0], i + 1) for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[0])))]
    assert rows(out, "id", "n") == sorted(want, key=repr)


def test_heartbeat_matches_loop(frame, data, spark):
    prior = spark.createDataFrame([("hot", 4), ("a", 0), ("new", 9)], "k string, streak long")
    for p, start in ((None, {}), (prior, {"hot": 4})):
        want = []
        for key, group in by_key(data).items():
            n = start.get(key, 0)
            for r in group:
                n = 0 if r[4] else n + 1
                want.append((r[0], n, n >= 3))
        got = ordered.heartbeat(frame, "k", ["ts", "id"], "ok", 3, prior=p)
        assert rows(got, "id", "streak", "alarm") == sorted(want, key=repr)


def test_quantiles_match_interpolation(spark):
    rnd = random.Random(1)
    data = [("hot", float(rnd.randrange(100)) / 4) for _ in range(301)] + [("one", 5.0)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in sg.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for key in ("hot", "one", "two"):
        vals = sorted(v for k, v in data if k == key)

        def q(p):
            pos = p * (len(vals) - 1)
            lo = int(pos)
            hi = min(lo + 1, len(vals) - 1)
            return vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)

        assert got[key].p50 == pytest.approx(statistics.median(vals))
        assert got[key].p99 == pytest.approx(q(0.99))
        assert got[key].n == len(vals)
    assert sg.exact_quantiles(df, [], "v", {"p": 1.0}).first().p == max(v for _, v in data)


def test_even_keys_take_the_plain_plan(spark):
    even = spark.range(2000).select(F.col("id"), (F.col("id") % 500).alias("k"), F.timestamp_seconds("id").alias("ts"))
    layout = sg.find_layout(even, ["k"], "ts")
    assert layout.plain
    out = sg.running(even, ["k"], ["ts"], {"n": ("sum", F.lit(1))}, layout=layout)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(out.groupBy("n").count()) == [(i, 500) for i in range(1, 5)]


def test_both_layouts_agree(frame):
    calcs = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v"))}
    plain = sg.Layout(("k",), "ts", None, None)
    a = sg.running(frame, ["k"], ["ts", "id"], calcs, layout=plain)
    assert rows(a, "id", "s", "hi") == rows(sg.running(frame, ["k"], ["ts", "id"], calcs), "id", "s", "hi")


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sg.running(empty, ["k"], ["ts"], {"s": ("sum", F.col("v"))}).count() == 0
    assert ordered.sequence_gaps(empty, "id").count() == 0


def test_trailing_sum_matches_loop(frame, data):
    out = ordered.trailing_sum(frame, ["k"], "ts", F.col("v"), 30, "s")
    want = []
    for r in data:
        lo = r[2] - dt.timedelta(seconds=30)
        want.append((r[0], sum(x[3] for x in data if x[1] == r[1] and lo <= x[2] <= r[2])))
    assert rows(out, "id", "s") == sorted(want, key=repr)


def test_sustained_matches_loop(frame, data):
    out = ordered.sustained(frame, ["k"], ["ts", "id"], F.col("ok"), 5)
    want = []
    for key, group in by_key(data).items():
        run = []
        for r in [*group, (None, key, None, 0, False)]:
            if r[4]:
                run.append(r)
            else:
                if run and (run[-1][2] - run[0][2]).total_seconds() >= 5:
                    want.append((key, run[0][2], run[-1][2], len(run)))
                run = []
    assert rows(out, "k", "started", "ended", "samples") == sorted(want, key=repr)


def test_text_orders_are_cut_like_numbers(spark):
    """The same rows in both layouts, with an order that is text, a struct, or null, and weights of both signs."""
    rng = random.Random(5)
    data = [(i, i % 3 if i % 2 else 0, None if i % 41 == 0 else f"{rng.randrange(40):08x}:{i % 7}", rng.randrange(-5, 6)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, k int, pos string, v int").withColumn("both", F.struct("pos", "id"))
    hot = spark.createDataFrame([((0,),)], "__group struct<k:int>").withColumn("__hot", F.lit(True))
    for order in ("pos", "both"):
        cut = sg.Layout(("k",), order, sg.find_borders(df, order, 2), hot)
        plain = sg.Layout(("k",), order, None, None)
        calls = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v"))}
        run = [rows(sg.running(df, ["k"], [order, "id"], calls, layout=x), "id", "s", "hi") for x in (cut, plain)]
        assert run[0] == run[1]
        lag = [rows(sg.lagged(df, ["k"], [order, "id"], {"p": F.col("v")}, layout=x), "id", "p") for x in (cut, plain)]
        assert lag[0] == lag[1]
        streak = [rows(sg.streaks(df, ["k"], [order, "id"], F.col("v"), F.col("v") == 3, "n", layout=x), "id", "n") for x in (cut, plain)]
        assert streak[0] == streak[1]


def test_an_order_that_cannot_be_cut_fails_at_every_size(spark):
    df = spark.createDataFrame([(1, [1])], "k int, pos array<int>")
    with pytest.raises(TypeError):
        sg.find_layout(df, ["k"], "pos")


def test_trailing_sum_of_one_crowded_key(spark):
    """All rows of one key within one window: the work is linear."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.timestamp_millis("id").alias("ts"), F.lit(1).alias("v"))
    out = ordered.trailing_sum(df, ["k"], "ts", F.col("v"), 3600, "s").agg(F.max("s"), F.sum("s")).first()
    assert tuple(out) == (200_000, 200_000 * 200_001 // 2)
