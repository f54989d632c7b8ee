"""Ranked search, trigram scores and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF_DIR
from evenkeel.llm import conversation, maxscore, ngram_scores
from evenkeel.llm.eftrie import EliasFano, Trie, compiled

DOCS = "doc_id long, text string, score string, segment int, term int, chunk string, shard int, places int, lang string"
BLANKS = re.compile(r"[^\x20\x09-\x0D]")


def documents(seed=5, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Straße", "ΑΒΓ", "don't", "a_b", "x\u0085y", "日本", "THE", "the", "#!"]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the the THE"), (4, "other text of the same id"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (6, " ".join(rng.choice(words) for _ in range(6000)))]
    rows += [(10 + i, rng.choice(["w1 w2 w3 w4", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(1, 50)))])) for i in range(n)]
    return [(i, t, None, 1, None, "x", 2, None, None) for i, t in rows]


def terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, top=50):
    counts = [(i, Counter(terms(t))) for i, t, *_ in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 w2 w3 w1"), (2, "THE straße ΑΒΓ zzz"), (3, None), (4, "nowhere"), (5, " ".join(f"w{i}" for i in range(30))), (5, "w7 w9"), (6, "w29 w28 w27 日本"), (6, "w29 w28 w27 日本"), (None, "x\u0085y a")]


def test_search_equals_a_scan_of_all_documents(spark, monkeypatch):
    docs = documents()
    index = maxscore.build_index(spark.createDataFrame(docs, DOCS).repartition(5))
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, rank string")
    for top in (50, 3):
        got = sorted(map(tuple, maxscore.search(index, items, top).collect()), key=repr)
        assert got == ranked(docs, ITEMS, top)
    monkeypatch.setattr(maxscore, "BLOCK_TERMS", 40)  # items in several blocks
    assert sorted(map(tuple, maxscore.search(index, items).collect()), key=repr) == ranked(docs, ITEMS)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maxscore.search(maxscore.build_index(docs), items).collect() == []
    some = maxscore.build_index(spark.createDataFrame(documents(), DOCS))
    assert maxscore.search(some, items.limit(0)).collect() == []
    assert maxscore.search(some, spark.createDataFrame([(1, None)], "item_id long, text string")).collect() == []


def test_pair_bounds_hold_and_skip_more_than_single_bounds():
    """Over random segments: nothing is lost, and fewer documents are scored with the pairs than without."""
    rng = np.random.default_rng(3)
    with_pairs, without = {}, {}
    for _ in range(60):
        n, own = 400, list(range(8))
        single = {}
        for t in own:
            where = np.sort(rng.choice(n, rng.integers(3, 60), replace=False)).astype(np.int32)
            single[t] = where, rng.integers(1, 1000, len(where)) * (t + 1)
        peaks = {t: int(v.max()) for t, (_, v) in single.items()}
        dense = np.zeros((8, n), np.int64)
        for t, (where, v) in single.items():
            dense[t, where] = v
        pairs = {p: k for k, p in enumerate(itertools.combinations(own, 2))}
        joints = {(a, b): int(j.max()) for a, b in pairs if len(j := (dense[a] + dense[b])[(dense[a] > 0) & (dense[b] > 0)])}
        whole = dense.sum(axis=0)
        for top in (1, 5, 50):
            best = np.sort(whole)[::-1][:top]
            floor = int(best[-1]) if top < 50 else 0
            for p, j, counted in ((pairs, joints, with_pairs), ({}, {}, without)):
                there, score = maxscore.search_segment(own, single, peaks, j, p, n, floor, top, counted)
                assert sorted(score.tolist(), reverse=True)[:top] == best.tolist()
                assert (whole[there] == score).all()
    assert with_pairs["scored"] < without["scored"]


def test_elias_fano_and_trie_find_what_is_there():
    rng = np.random.default_rng(1)
    for values in ([0], [5, 5, 5], list(range(100)), np.sort(rng.integers(0, 1 << 40, 5000)), [0, (1 << 50)]):
        values = np.array(values, np.int64)
        coded = EliasFano(*EliasFano.parts(values))
        assert (coded.all() == values).all()
        asked = np.concatenate([values, values + 1, [-1, 1 << 51]])
        assert [int(p) >= 0 for p in coded.find(asked)] == [int(x) in set(values.tolist()) for x in asked]
    grams = np.unique(rng.zipf(1.3, (20_000, 3)) % 3000, axis=0)
    grams = grams[np.lexsort((grams[:, 2], grams[:, 0], grams[:, 1]))]
    contexts, of = np.unique(grams[:, 1] << 32 | grams[:, 0], return_inverse=True)
    codes = np.arange(len(contexts)) % 60000
    trie = Trie.mapped(compiled(contexts & 0xFFFFFFFF, contexts >> 32, of, grams[:, 2], codes, codes, np.arange(len(grams)) % 60000))
    place, word = trie.find_contexts(grams[:, 0], grams[:, 1])
    assert (place == of).all() and (trie.find_grams(place, word, grams[:, 2]) == np.arange(len(grams))).all()
    there = {tuple(g) for g in grams.tolist()}
    asked = rng.zipf(1.3, (5000, 3)) % 3000
    place, word = trie.find_contexts(asked[:, 0], asked[:, 1])
    assert [p >= 0 for p in trie.find_grams(place, word, asked[:, 2]).tolist()] == [tuple(a) in there for a in asked.tolist()]


real_unique = np.unique
WORDS_OF_CHUNK = [f"w{int(1.015 ** k)}" for k in range(700)]


def tokens(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def trigram_scores(rows):
    held = lambda i: zlib.crc32(str(" " if i is None else i).encode()) % 7 == 2
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            w = tokens(t)
            x = ["<", "<", *w]
            starts += 1
            one.update(w)
            two.update(zip(x[1:], w))
            three.update(zip(x, x[1:], w))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = score = 0.0
        for a, b, c in zip(["<", "<", *w], ["<", *w], w):
            p1 = (one[c] + 1) / (n + v + 1)
            p2 = (two[b, c] + ngram_scores.MU2 * p1) / ((starts if b == "<" else one[b]) + ngram_scores.MU2)
            p3 = (three[a, b, c] + ngram_scores.MU3 * p2) / ((starts if a == b == "<" else two[a, b]) + ngram_scores.MU3)
            base, score = base + math.log10(p1), score + math.log10(p3)
        out.append((i, held(i), len(w), sum(one[c] > 0 for c in w), n, base, score))
    return out


@pytest.mark.parametrize("size", [ngram_scores.CHUNK_TOKENS, 300])
def test_scores_equal_counts_in_a_loop(spark, monkeypatch, size):
    """Two codes of 1/128 of a unit: a token's logarithm is off by 1/128 at most."""
    rows = documents(9)
    df = spark.createDataFrame(rows, DOCS).repartition(1 if size > 300 else 7)
    got = sorted(map(tuple, ngram_scores.score(df).collect()), key=lambda r: repr(r[:5]) + f"{r[5]:.6f}")
    want = sorted(trigram_scores(rows), key=lambda r: repr(r[:5]) + f"{r[5]:.6f}")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= g[2] / 128


def test_counts_are_looked_up_once_for_each_word_of_a_chunk(monkeypatch):
    """A search for each token, and sorts by hashes, are what op12's CPU seconds went to (F1)."""
    monkeypatch.setattr(ngram_scores, "HOT", 3)
    rng = random.Random(5)
    texts = [[rng.choice(WORDS_OF_CHUNK) for _ in range(rng.randrange(400))] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    known_words = Counter(w for i, t in rows if not ngram_scores.held_out(i) for w in tokens(t))
    order = sorted(known_words, key=lambda w: (-known_words[w], w))
    number = {w: k for k, w in enumerate(order)}
    here = sorted({w for _, t in rows for w in tokens(t)}, key=lambda w: zlib.crc32(w.encode()))
    place = {w: k for k, w in enumerate(here)}
    rungs = sorted(Counter(known_words.values()).items(), reverse=True)
    known = ngram_scores.Vocabulary(sum(known_words.values()), len(order), known_words["\n"], np.array([n for n, _ in rungs]), np.cumsum([c for _, c in rungs]))
    put = ngram_scores.put
    dealt = np.arange(len(here)) % 3
    row = {"chunk": 1, "ids": [i for i, _ in rows], "held": [ngram_scores.held_out(i) for i, _ in rows], "sizes": put(np.array([len(tokens(t)) for _, t in rows])),
           "tokens": put(np.array([place[w] for _, t in rows for w in tokens(t)])), "dealt": put(dealt)}
    ids = {s: put(np.array([number.get(here[k], -1) + 1 for k in np.flatnonzero(dealt == s)])) for s in range(3)}
    chunk = ngram_scores.Chunk(row, ids, known)
    answers, split = {}, Counter()
    for sent in ngram_scores.send(row, chunk, 4):
        for part in ngram_scores.answer(sent["shard"], [(1, sent["parts"])], known):
            if part["chunk"] is None:
                split[part["w2"] << 32 | part["w1"]] += part["total"]
            else:
                answers[sent["shard"]] = part["parts"]
    asked, count = [], ngram_scores.Vocabulary.count
    monkeypatch.setattr(ngram_scores.Vocabulary, "count", lambda self, which: asked.append(len(which)) or count(self, which))
    unique = []
    monkeypatch.setattr(ngram_scores.np, "unique", lambda x, **more: unique.append(len(x)) or real_unique(x, **more))
    got = ngram_scores.add_up(row, chunk, answers, (np.array(sorted(split)), np.array([split[k] for k in sorted(split)])), 4, known)
    want = trigram_scores(rows)
    assert got["n_known"].tolist() == [w[3] for w in want] and got["base_score"].tolist() == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(abs(g - w[6]) <= w[2] / 128 for g, w in zip(got["score"], want))
    assert 0 < int(chunk.split.sum()) < 20 and max(asked) <= len(here) + 2 < sum(len(tokens(t)) for _, t in rows) / 10
    assert unique == []


@pytest.mark.parametrize("top", [1 << 20, 1 << 60])
def test_keys_are_ranked_like_unique_ones(top):
    keys = np.random.default_rng(1).integers(0, 300, 5000) * (top // 300)
    for some in (keys, keys[:1], keys[:0]):
        for got, want in zip(ngram_scores.ranked(some, top), np.unique(some, return_inverse=True)):
            assert got.tolist() == want.tolist()
    for top in (300, 1 << 16, 1 << 17):
        values = np.random.default_rng(2).integers(0, top, 5000)
        assert ngram_scores.by_number(values, top).tolist() == np.argsort(values, kind="stable").tolist()


def test_split_contexts_give_the_same_scores(spark, monkeypatch):
    rows = documents(9)
    df = spark.createDataFrame(rows, DOCS)
    whole = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in ngram_scores.score(df).collect()}
    want = {(r[0], r[2], round(r[5], 6)): r[6] for r in trigram_scores(rows)}
    assert whole.keys() == want.keys()
    # every word of this small vocabulary is among the HOT ones; the loop above knows no split
    assert all(abs(whole[k] - want[k]) <= k[1] / 128 for k in whole)


def test_scores_without_rows_or_training_text(spark):
    assert ngram_scores.score(spark.createDataFrame([], DOCS)).collect() == []
    held = [i for i in range(200) if ngram_scores.held_out(i)][:3]
    rows = [(i, t, *[None] * 7) for i, t in zip(held, (None, "", "a b a"))]
    got = {r["doc_id"]: r for r in ngram_scores.score(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.values()} == {(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)}


def test_probabilities_of_a_context_add_up_to_one():
    rows = [(i, t, None) for i, (_, t, *_) in enumerate(documents(3)[9:40])]
    words = sorted({w for _, t, _ in rows if not ngram_scores.held_out(_) for w in tokens(t)})
    train = [(i, t) for i, t, _ in rows if not ngram_scores.held_out(i)]
    words = sorted({w for _, t in train for w in tokens(t)})
    one = Counter(w for _, t in train for w in tokens(t))
    two = Counter(p for _, t in train for p in zip(tokens(t), tokens(t)[1:]))
    n, v = sum(one.values()), len(one)
    total = 0.0
    for w in [*words, "unseen"]:
        p1 = (one[w] + 1) / (n + v + 1)
        total += (two["w1", w] + ngram_scores.MU2 * p1) / (one["w1"] + ngram_scores.MU2)
    assert total == pytest.approx(1)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for copy in range(0 if kind == 0 else 2 if kind == 3 else 1):
            out.setdefault(conv, []).append((turn is not None, turn or 0, role, text, copy))
    return {c: [(t if has else None, r, x) for has, t, r, x, _ in sorted(v)] for c, v in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not BLANKS.search(text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits over the role initials so far, kept per prefix class by plain strings."""
    best = {"": (0, "", [])}  # last initial -> cost, audit, repaired
    order = lambda x: (x[0], x[1])

    def put(table, state, cand):
        if state not in table or order(cand) < order(table[state]):
            table[state] = cand

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                put(table, role[0], (cost + 3, audit + "I", [*out, f"{role}:"]))
        return table

    for (_, role, text), fault in zip(rows, faults):
        table = {}
        more = 3 if fault == "truncated" else 0
        for state, (cost, audit, out) in inserted(dict(best)).items():
            put(table, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            made = "assistant" if state == "u" else "user"
            put(table, made[0], (cost + 3 + more, audit + "R", [*out, f"{made}:{text}"]))
            if role[:1] == made[0] or (role[:1] == "s" and state == ""):
                put(table, role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
        best = table
    return min((v for s, v in inserted(dict(best)).items() if s in ("", "a")), key=order)


def report(rows):
    rows_of, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = rows_of.get(conv, [])
        faults = faults_of(own)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None, 1000]:
        for turn in rng.sample([None, *range(40)], rng.randrange(1, 9)) if conv != 1000 else range(400):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            rows.append((conv, turn, role, rng.choice([f"Text {rng.randrange(5)}.", "no end", "", None, " \t", "Ok! \n", "Wo?", "x."])))
    return rows + [rows[0], rows[0], (7, 3, "user", "Tie."), (7, 3, "assistant", "Tie."), (2000, None, None, None)]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("most", [conversation.STRETCH, 3])
def test_repair_equals_plain_strings(spark, most):
    rows = conversations(2)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, audit string, seq int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in conversation.audit_report(df, most).collect()), key=repr)
    assert got == report(rows)


def test_repair_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in conversation.audit_report(df).collect()), key=repr) == report(rows)
    assert conversation.audit_report(df.limit(0)).collect() == []


def test_repaired_turns_follow_the_audit(spark):
    rows = conversations(4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, solved = conversation.repair(conversation.damage(df), 5)
    by_conv = {}
    for r in sorted(conversation.repaired_turns(turns, solved).collect(), key=lambda r: r["place"]):
        by_conv.setdefault(r["conv_id"], []).append(r)
    for r in solved.collect():
        got = by_conv.get(r["conv_id"], [])
        assert "".join(x["edit"] for x in got) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in got))


def test_ties_are_settled_even_if_all_hashes_collide(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(conversation, "PRIME", 1)  # every hash is 0
    for _ in range(200):
        part = conversation.Stretch(0, 0, True)
        rows = [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c"])) for k in range(rng.randrange(1, 9))]
        faults = faults_of(rows)
        for (turn, role, _), fault in zip(rows, faults):
            part.add(turn, role[:1], ["", "blank", "duplicate", "truncated"].index(fault))
        done = conversation.chained([part.row()])
        assert (done["cost"], done["audit"]) == cheapest(rows, faults)[:2]
