"""Cases that need a large text, few labels, or a benchmark in several slices."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from evenkeel.llm import components, crf, kneser_ney, lsa, weak_pii


def test_a_text_of_very_many_matches_takes_linear_time(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, " ".join(f"mail a{i}@b.com" for i in range(n)))], "doc_id long, text string")
    row = weak_pii.find_pii(docs).select("base", "spans").first()
    places, at = [], 0
    for i in range(n):
        body = f"a{i}@b.com"
        places.append((at + 5, 0, at + 5 + len(body)))
        at += 5 + len(body) + 1
    assert [tuple(s) for s in row["base"]] == places and row["spans"] == row["base"]


def test_query_counts_each_kind(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "4111111111111111"), (2, "1.2.3.4 5.6.7.8 a@b.co"), (3, "+1 234 567 890"), (4, "a@b.co c@d.org"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op9_pii_weak_supervision"](spark, str(tmp_path)).orderBy("doc_id").select("n_email", "n_ip", "n_card", "n_phone").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0), (1, 2, 0, 0), (0, 0, 0, 1), (2, 0, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("dense_words", [6000, 0])
def test_gram_matrix_adds_up_every_passage(spark, monkeypatch, dense_words):
    monkeypatch.setattr(lsa, "DENSE_WORDS", dense_words)
    monkeypatch.setattr(lsa, "DENSE", 90)  # blocks of three rows of 30 words
    monkeypatch.setattr(lsa, "PAIRS", 500)
    rng = np.random.default_rng(1)
    idf = rng.uniform(0.1, 3, 30)
    texts = [rng.integers(-1, 30, rng.integers(0, 100)).astype("<i4") for _ in range(9000)]  # more than a sample of 4,000 had
    want = np.zeros((30, 30))
    for ids in texts:
        for at in range(0, len(ids), 32):
            lsa.add_passage(want, ids[at : at + 32], idf, np.eye(30))
    coded = spark.createDataFrame([(x.tobytes(),) for x in texts], "ids binary").repartition(5)
    got = np.zeros(900)
    for r in lsa.gram_matrix(coded, idf).collect():
        got[np.frombuffer(r["codes"], "<i4") + r["block"] * 90] += np.frombuffer(r["sums"], "<f4")
    assert np.allclose(got.reshape(30, 30), np.triu(want), rtol=1e-4, atol=1e-3)
    items = lsa.Items(["a"], {str(w): w for w in range(30)}, [list(range(30))])
    table = lsa.latent_space(coded, items, idf)
    lsa.add_passage(want, np.arange(30), idf, np.eye(30))
    directions = table / idf[:, None]
    assert np.allclose(directions.T @ want @ directions, np.diag(np.sort(np.linalg.eigvalsh(want))[::-1]), rtol=1e-2, atol=1)


def test_spans_come_once_and_sorted(spark):
    rows = spark.createDataFrame([([(5, 1, 9), (2, 3, 4), (5, 1, 9), (5, 0, 9)],), ([],)], "s array<struct<start:int,kind:int,end:int>>")
    got = [[tuple(x) for x in r[0]] for r in rows.select(weak_pii.without_repeats(F.col("s"))).collect()]
    assert got == [[(2, 3, 4), (5, 0, 9), (5, 1, 9)], []]


def planted(n=400, seed=3):
    """Texts with personal data that the base patterns miss, with numbers that are none, and with base matches; the true spans."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        total = sum((2 * d - 9 if d > 4 else 2 * d) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    rows, truth = [], set()
    for i in range(n):
        c = card()
        cue, body, kind = [
            ("contact", f"ann{i} (at) mail.example.org", 0),
            ("call", f"0{digits(3)} {digits(4)} {digits(4)}", 3),
            ("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", 2),
            ("order", f"{digits(4)}.{digits(3)}.{digits(4)}.x", None),
            ("invoice", f"9{digits(3)} {digits(4)} {digits(4)} {digits(4)}", None),
            ("page", f"{digits(2)} {digits(3)} {digits(3)}", None),
            ("mail", f"joe{i}@site.org", None),
            ("visa", c, None),
        ][i % 8]
        before = f"the house stands by the river and nobody went there {cue} "
        if kind is not None:
            truth.add((i, len(before), kind, len(before) + len(body)))
        rows.append((i, before + body + " and then it rained"))
    return rows, truth


def test_added_spans_recall_and_precision(spark):
    rows, truth = planted()
    found = weak_pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["doc_id"], *s) for r in found for s in {tuple(x) for x in r["spans"]} - {tuple(x) for x in r["base"]}}
    print(len(truth), len(added), len(added & truth))
    assert len(added & truth) >= 0.9 * len(truth)
    assert len(added & truth) >= 0.9 * len(added)


def test_few_toxic_documents_still_give_scores(spark):
    """Five toxic documents, fewer than SEED_DOCS of them outside the calibration, share one word."""
    docs = [(k, f"a plain day at sea number {k}" + " with a zork in it" * (k % 13 == 1)) for k in range(1, 60)]
    labels = spark.createDataFrame([(k, int(k % 13 == 1)) for k, _ in docs], "doc_id long, toxic int")
    model = crf.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    texts = spark.createDataFrame([(1, "one zork came"), (2, "a plain sea"), (3, ""), (4, None)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in crf.tag(texts, model).collect()}
    assert score[1] > 0.5 > max(score[2], score[3], score[4])


def test_a_benchmark_of_many_words_is_searched_in_slices(spark, monkeypatch):
    rng = random.Random(8)
    item = lambda k: " ".join(f"w{k}x{rng.randrange(1000)}" for _ in range(24))
    items = [(k, item(k)) for k in range(8)]
    filler = lambda: " ".join(rng.choice("sea river house field road tree stone light".split()) for _ in range(40))
    docs = [(100 + k, f"{filler()} {text} {filler()}") for k, text in items] + [(200 + k, filler()) for k in range(20)]
    benchmark = spark.createDataFrame([*items, (50, None)], "item_id long, text string")
    read, sizes = lsa.read_items, []
    monkeypatch.setattr(lsa, "read_items", lambda rows: sizes.append(len(rows)) or read(rows))
    monkeypatch.setattr(lsa, "SLICE_WORDS", 60)  # 192 words
    found = lsa.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert len(sizes) == 4 and sum(sizes) == 8
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(100 + k, k) for k, _ in items}


def test_edges_that_lead_to_their_roots_take_no_round(spark, monkeypatch):
    rounds, star = [], components.star
    monkeypatch.setattr(components, "star", lambda edges, large: rounds.append(large) or star(edges, large))
    edges = [(i, i % 10) for i in range(10, 200)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, i % 10) for i in range(200)} and not rounds
    found = components.connected_components(spark.createDataFrame([*edges, (5, 4)], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, 4 if i % 10 == 5 else i % 10) for i in range(200)} and len(rounds) == 2


def test_no_subsequence_is_sought_where_too_few_words_are_there(monkeypatch):
    items = lsa.read_items([(1, "one two three four five six seven eight"), (2, "nine ten")]).prepare()
    sought, matched = [], lsa.matched
    monkeypatch.setattr(lsa, "matched", lambda found, size: sought.append(size) or matched(found, size))
    assert lsa.checked(items, 0, np.array([0, 1, 2, 3, 3, 3, 3, 3, -1]), 0) == 0.0 and not sought
    assert lsa.checked(items, 1, np.array([8, -1, 8]), 0) == 0.0 and not sought
    assert lsa.checked(items, 0, np.array([7, 0, 1, 2, 3, -1, 4, 5, 6, 7]), 0) == 1.0
    assert lsa.checked(items, 1, np.array([9, 8, 9]), 0) == 1.0 and sought == [8, 2]


def test_passage_sums_equal_a_loop():
    random = np.random.default_rng(3)
    table = random.standard_normal((30, 5)).astype(np.float32)
    for n in (1, 7, 8, 9, 40, 333):
        ids = random.integers(-10, 30, n)
        steps = [sum((table[i] for i in ids[a : a + lsa.STEP] if i >= 0), np.zeros(5, np.float32)) for a in range(0, n, lsa.STEP)]
        for length in (2, 4):
            sums = [sum(steps[k : k + length]) for k in range(max(1, len(steps) - length + 1))]
            assert np.allclose(lsa.passage_matrix(ids, table, length), sums, atol=1e-5)


def test_rounds_of_parcels_send_each_shard_once():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << kneser_ney.KEY_BITS, 5000, dtype=np.uint64))
    every = list(kneser_ney.parcels(1, keys, [keys], 17))
    parts = [p for now in range(3) for p in kneser_ney.parcels(1, keys, [keys], 17, 3, now)]
    assert len(every) == 17 and sorted(parts, key=lambda p: p["shard"]) == every


def test_shuffled_files_go_with_the_write(spark, tmp_path):
    def files():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in kept.split() if f.endswith(".data")}

    before, setting = files(), spark.conf.get(kneser_ney.CLEANUP)
    for _ in range(2):
        kneser_ney.write_and_clean(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), f"{tmp_path}/out")
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and spark.conf.get(kneser_ney.CLEANUP) == setting
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14
