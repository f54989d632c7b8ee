"""Text operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_DIR
from evenkeel.llm import bpe, crf, kneser_ney, ledger, lsa, minhash, resync, sparse_suffix, transducer, weak_pii, winnow
from evenkeel.llm.components import connected_components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# other columns that have the names operators use inside
CLASHING = SCHEMA + ", key long, score string, spans int, place int, row string, lines int, kept int, removed int, ids int, decoded2 int"


def awkward():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(11)
    words = "the of and on erinth thwhed réeux ñado ciónñ ÖSTER a.b 12 it's don't x|y ### !!".split()
    long_text = " ".join(rng.choice(words) for _ in range(9000)) + "\n" + "q" * 5000
    passage = " ".join(f"w{i}" for i in range(70))
    lines = "\n".join(f"line {i} here" for i in range(6))
    texts = [None, "", "   ", "\n\n", "one", "Straße ΑΣΣΟΣ ΣΑΣ <|endoftext|> 日本語 \x1c\x85 é", long_text, long_text + " end", passage, "before " + passage + " after", lines, "top\n" + lines + "\nbottom"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if i % 2 else 3) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, passage, None, None, None), (None, None, None, None, None), (4, "other text of the same id", "en", "s", 1)]
    for i in range(40):
        rows.append((100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), "en", "s", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def order(rows):
    return sorted(rows, key=repr)


def test_encoding_equals_the_library(spark, docs, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    got = order((r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in transducer.digests(docs, WORD_BPE).collect())
    want = []
    for i, text, *_ in awkward():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len(ids)))
    assert got == order(want)
    assert transducer.digests(nothing, WORD_BPE).count() == 0
    both = transducer.decode(transducer.encode(docs, WORD_BPE).select("doc_id", "ids"), WORD_BPE).collect()
    assert order((r["doc_id"], hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in both) == order((w[0], w[2]) for w in want)


def test_random_texts_encode_like_the_library():
    library, own = Tokenizer.from_file(WORD_BPE), transducer.Words(bpe.load(WORD_BPE), None)
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 40 + "'s", "<|startoftext|><|ENDOFTEXT|> x<|endoftext|>y"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w + e: [len(w), i] for w in ("walk", "talk", "stalk", "wal", "é") for i, e in enumerate(("", "s", "ed", "ing"))}
    file = tmp_path / "words.bin"
    file.write_bytes(transducer.compile_words(words))
    lexicon = transducer.Lexicon(str(file))
    assert all(lexicon.lookup(w) == ids for w, ids in words.items())
    assert [lexicon.lookup(w) for w in ("", "w", "walke", "walking!", "zz")] == [None] * 5
    letters = sum(map(len, words))
    assert len(lexicon.final) < letters / 4  # endings share their states
    empty = tmp_path / "none.bin"
    empty.write_bytes(transducer.compile_words({}))
    assert transducer.Lexicon(str(empty)).lookup("a") is None


def test_new_words_are_learnt_side_by_side(tmp_path):
    """Work for each new word in Python code is what op1's CPU seconds went to (F2)."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéüß'!?1\u0416"
    chunks = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(20000)} - {""})
    tokenizer, library = bpe.load(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    long = ["x" * 70, "é!" * 50, "x" * 71]
    ids = transducer.Words(tokenizer, None)
    ids.learn({*chunks[::2], *long[:2]})
    file = tmp_path / "words.bin"
    file.write_bytes(transducer.compile_words({w: np.frombuffer(ids.encode([w])[0], "<i4").tolist() for w in (*chunks[::2], *long[:2])}))
    lexicon = transducer.Lexicon(str(file))
    asked = [*chunks, *long, "z" * 30, "\U0001F600"]
    assert [p >= 0 for p in lexicon.places(asked).tolist()] == [lexicon.lookup(w) is not None for w in asked] == [*(i % 2 == 0 for i in range(len(chunks))), True, True, False, False, False]
    texts = [" ".join(asked), "", "<|endoftext|>", "a <|endoftext|><|ENDOFTEXT|> b", *(" ".join(asked[k : k + 7]) for k in range(0, len(asked), 999))]
    words, calls = transducer.Words(tokenizer, lexicon), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = words.encode(texts)
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    beyond = sum("\u0416" in w for w in asked)  # these go through the library's splitter one by one
    assert calls < len(asked) / 2 + 2 * beyond, calls


def test_ids_are_put_together_in_blocks(monkeypatch):
    monkeypatch.setattr(transducer, "SLICES", 3)
    values, starts, sizes = np.arange(100), np.array([5, 0, 90, 7, 7, 50, 3]), np.array([2, 0, 10, 1, 1, 0, 4])
    want = [v for a, n in zip(starts.tolist(), sizes.tolist()) for v in range(a, a + n)]
    assert transducer.slices(values, starts, sizes).tolist() == want
    assert transducer.slices(values, starts[:0], sizes[:0]).tolist() == []


def test_a_null_list_of_ids_decodes_to_the_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "doc_id long, ids array<int>")
    library = Tokenizer.from_file(WORD_BPE)
    assert [r["decoded"] for r in transducer.decode(rows, WORD_BPE).orderBy("doc_id").collect()] == ["", "", library.decode([320, 49407], skip_special_tokens=False)]


def test_frequent_words_stay_within_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(1000)], "word string, n long")
    chosen = [r["word"] for r in transducer.frequent_words(counts, 300).collect()]
    assert 0 < len(chosen) <= 300
    n = dict((f"w{i}", 1 + i // 10) for i in range(1000))
    low = min(n[w] for w in chosen)
    assert set(chosen) == {w for w in n if n[w] >= low}


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_measurements(docs, nothing):
    got = {}
    for r in ledger.apply_policy(ledger.ledger(docs)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"], r["failed"]))
    for i, text, *_ in awkward():
        w, t = words_in(text), text or ""
        grams = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        covered = {a + k for a in range(len(w) - 7) if grams[tuple(w[a : a + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if words_in(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert want in [g[:5] for g in got[i]], (i, want)
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            assert all(not g[5] for g in got[i] if g[:5] == want)
    assert ledger.ledger(nothing).count() == 0


def test_policies_and_ablation_read_the_ledger(docs):
    book = ledger.ledger(docs).cache()
    failed = [r["failed"] for r in book.collect()]
    for version, mask in ledger.POLICIES.items():
        assert ledger.apply_policy(book, version).where("kept").count() == sum(f & mask == 0 for f in failed)
        for r in ledger.ablation(book, version).collect():
            bit = ledger.BITS[r["rule"]]
            assert (r["failing"], r["alone"]) == (sum(bool(f & bit) for f in failed), sum(f & mask == bit for f in failed))


@pytest.mark.parametrize("chunk,overlap", [(32768, 1024), (70, 20), (128, 17)])
def test_token_counts_equal_the_library(spark, docs, nothing, chunk, overlap):
    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(2)
    extra = [(900, "".join(rng.choice("ab '\n<|endoftext|>1é😀 ") for _ in range(3000))), (901, "wo'll <|endoftext|>\x1c \x85 " * 300), (902, " " * 4000 + "b")]
    rows = [(i, t) for i, t, *_ in awkward()] + extra
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = order(tuple(r) for r in resync.token_counts(df, BYTE_BPE, chunk, overlap).collect())
    assert got == order((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert resync.token_counts(nothing, BYTE_BPE).count() == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_personal_data(spark, docs, nothing):
    rng = random.Random(3)
    parts = ["1", "2", ".", "@", "+", "-", " ", "a", "4111111111111111", "é", "😀", "(", "12", "255", "\n", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(60))) for i in range(400)]
    rows += [(1000, "a@b.c_d@e.f 1.2.3.4.5.6.7.8"), (1001, "1" * 9000), (1002, "a" * 20000 + "@x"), (1003, "1 " * 3000), (1004, None), (1005, ""), (1006, "0001.000.0255.1 256.1.1.1"), (None, "+1 234 567 8901")]
    got = {r["doc_id"]: r for r in weak_pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = [tuple(s) for s in got[i]["base"]]
        assert base == base_spans(text), (i, text)
        assert set(base) <= {tuple(s) for s in got[i]["spans"]}
    assert weak_pii.find_pii(nothing).count() == 0
    assert weak_pii.find_pii(docs).count() == len(awkward())


def test_votes_separate_reliable_labelers():
    patterns = [((1, 1, 1, 1, 1), 80), ((-1, -1, -1, -1, -1), 80), ((1, 1, 0, 1, -1), 9), ((-1, 0, -1, -1, 1), 9)]
    p = weak_pii.estimate(patterns)
    assert p[(1, 1, 1, 1, 1)] > 0.9 and p[(1, 1, 0, 1, -1)] > 0.5 > p[(-1, 0, -1, -1, 1)] and p[(-1, -1, -1, -1, -1)] < 0.1
    assert weak_pii.train([]) == []


def later_repeats(rows):
    """Kept text and removed lines of each document: runs of three lines, or of fifty words, count."""
    rows = sorted({(i is None, i, t or "") for i, t, *_ in rows}, key=lambda x: (x[0], x[1] or 0))
    seen, want = {}, set()
    for _, i, text in rows:
        parts = text.split("\n")
        filled = [k for k, x in enumerate(parts) if words_in(x)]
        gone = set()
        for lines in (1, 2, 3):
            for a in range(len(filled) - lines + 1):
                window = tuple(parts[k].strip(" \t\r") for k in filled[a : a + lines])
                if lines < 3 and sum(len(words_in(x)) for x in window) < 50:
                    continue
                if seen.setdefault(window, (i, a)) != (i, a):
                    gone.update(filled[a : a + lines])
        want.add((i, "\n".join(x for k, x in enumerate(parts) if k not in gone), tuple(sorted(gone))))
    return want


def deduped(df):
    return {(r["doc_id"], r["kept"], tuple(r["removed"])) for r in winnow.dedup_lines(df).collect()}


def test_line_dedup_matches_loop(docs, nothing):
    assert deduped(docs.where("doc_id IS NOT NULL AND doc_id <> 4")) == later_repeats(r for r in awkward() if r[0] not in (None, 4))
    assert winnow.dedup_lines(nothing).count() == 0
    assert winnow.dedup_lines(docs).count() == len(awkward())


def test_long_lines_count_alone_and_in_pairs(spark):
    long = " ".join(f"w{i}" for i in range(80))
    half, rest = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, long), (2, "head\n" + long + " \ntail"), (3, long + "\n" + long), (4, long), (5, half + "\n\n" + rest), (6, "x\n" + half + "\n" + rest), (7, half), (8, rest + "\n" + half), (9, " ".join(f"a{i}" for i in range(49))), (10, " ".join(f"a{i}" for i in range(49))), (11, None)]
    got = deduped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == later_repeats(rows)
    assert {(i, gone) for i, _, gone in got} == {(1, ()), (2, (1,)), (3, (0, 1)), (4, (0,)), (5, ()), (6, (1, 2)), (7, ()), (8, ()), (9, ()), (10, ()), (11, ())}


def near_duplicates(rows, threshold=0.8):
    sets, links, root = [], [0] * len(rows), list(range(len(rows)))
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else None)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    return order((rows[k][0], min((i for i in members[find(k)] if i is not None), default=None), links[k]) for k in range(len(rows)))


def test_jaccard_join_matches_all_pairs(spark, docs, given, nothing, monkeypatch):
    for df in (docs, given):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = order((r["doc_id"], r["class_id"], r["n_links"]) for r in minhash.jaccard_join(df).collect())
        assert got == near_duplicates(rows)
    assert minhash.jaccard_join(nothing).count() == 0


def test_blocks_of_a_group_find_every_link(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    got = order((r["doc_id"], r["class_id"], r["n_links"]) for r in minhash.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_duplicates(rows)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = minhash.choose_bands(threshold, recall)
        assert bands * rows <= minhash.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        minhash.choose_bands(0.1, 0.999999, 20)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 160)]
    got = {(r["key"], r["root"]) for r in connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeated(rows, length=50):
    seen, covered, words = defaultdict(set), defaultdict(set), []
    for k, (_, text) in enumerate(rows):
        w = (text or "").split()
        words.append(w)
        for a in range(len(w) - length + 1):
            seen[tuple(w[a : a + length])].add((k, a))
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                covered[k].update(range(a, a + length))
    out = []
    for k, places in covered.items():
        starts = [p for p in places if p - 1 not in places]
        out += [(rows[k][0], a, next(p for p in range(a, a + len(places) + 1) if p not in places)) for a in starts]
    return order(out)


def test_repeated_passages_match_loop(spark, docs, given, nothing):
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert order(tuple(r) for r in sparse_suffix.repeated_passages(given).collect()) == repeated(rows)
    distinct = list(dict.fromkeys((i, t) for i, t, *_ in awkward()))
    # most of the long random texts repeat by chance and are left out here: the loop is quadratic in them
    small = [(i, t) for i, t in distinct if len(t or "") < 5000]
    got = sparse_suffix.repeated_passages(spark.createDataFrame(small + small[:3], "doc_id long, text string"))
    assert order(tuple(r) for r in got.collect()) == repeated(small)
    assert sparse_suffix.repeated_passages(nothing).count() == 0
    assert sparse_suffix.repeated_passages(docs).count() > 0


def test_passages_that_end_in_a_hot_line_are_found(spark):
    rng = random.Random(5)
    hot = " ".join(f"hot{i}" for i in range(30))
    rows = []
    for pair in range(2600):  # the hot line's n-grams have more than 4096 suffixes
        shared = " ".join(f"s{pair}_{i}" for i in range(25))
        for side in range(2):
            before, after = (" ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) for _ in range(2))
            rows.append((2 * pair + side, f"{before} {shared} {hot} {after}"))
    got = sparse_suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(tuple(r) for r in got.collect()) == order((i, 20, 75) for i, _ in rows)


@pytest.mark.parametrize("copies", [3, 8, 9])
def test_passages_are_found_whatever_shares_their_middle(spark, copies):
    middle = " ".join(f"m{i}" for i in range(12))
    rows = []
    for i in range(copies):  # the first and the last share 20 words on each side, the others more on one side only
        left, right = (25 if i % 2 else 0, 0 if i % 2 else 25)
        if i in (0, copies - 1):
            left = right = 20
        words = [f"a{i}_{k}" for k in range(30 - left)] + [f"l{k}" for k in range(30 - left, 30)]
        rows.append((i, " ".join([*words, middle, *(f"r{k}" for k in range(right)), *(f"z{i}_{k}" for k in range(30 - right))])))
    got = sparse_suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(tuple(r) for r in got.collect()) == repeated(rows) == [(0, 10, 62), (copies - 1, 10, 62)]


def test_leaks_are_found_and_clean_texts_left(spark, given, nothing):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = lsa.read_items(sorted(((r["item_id"], r["text"]) for r in benchmark.collect()), key=repr)).prepare()
    want = set()
    for r in given.collect():
        ids = np.array([items.words.get(w, -1) for w in lsa.TOKEN.findall(r["text"].lower())], dtype="<i4")
        for at in range(0, max(1, len(ids)), lsa.STEP):
            near = set(ids[at : at + 32].tolist())
            want |= {(r["doc_id"], items.ids[j]) for j, x in enumerate(items.lists) if len(near.intersection(x)) > 0.15 * len(set(x)) and lsa.checked(items, j, ids, at)}
    got = {(r["doc_id"], r["item_id"]) for r in lsa.find_leaks(given, benchmark).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want
    assert lsa.find_leaks(nothing, benchmark).count() == 0
    assert lsa.find_leaks(given, benchmark.where("false")).count() == 0


def test_paraphrased_leaks_and_awkward_items(spark, docs):
    item = "what is the capital of the northern province and who built its oldest bridge answer old stone mason guild of harrow"
    text = "some words before. What is the main capital of the northern province, and who had built its oldest bridge? Answer: old stone mason guild of Harrow. words after"
    rows = [(1, text), (2, "the of and " * 50), (3, None)]
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "..."), (None, "tiny item"), (7, item)], "item_id long, text string")
    got = lsa.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7), (1, 7)]
    assert lsa.find_leaks(docs, benchmark).count() == 0


def test_recall_of_planted_items_of_every_length(spark):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(6000)]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.45 else rng.choice(rare) for _ in range(n)]

    sizes = {"short": (6, 12), "usual": (15, 59), "long": (100, 300)}
    items = [(kind, text(rng.randint(*sizes[kind]))) for kind in sizes for _ in range(40)]
    rows, planted = [], defaultdict(set)
    for copy in ("verbatim", "changed"):
        for j, (kind, words) in enumerate(items):
            own = list(words)
            for k in rng.sample(range(len(own)), len(own) // 5 if copy == "changed" else 0):
                own[k] = rng.choice(rare)
            planted[kind, copy].add((len(rows), j))
            rows.append((len(rows), " ".join([*text(rng.randrange(150)), *own, *text(rng.randrange(150))])))
    rows += [(len(rows) + k, " ".join(text(rng.randrange(20, 400)))) for k in range(300)]
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, (_, w) in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lsa.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    recall = {k: len(v & got) / len(v) for k, v in planted.items()}
    assert min(recall.values()) >= 0.9, recall


def test_slices_of_a_benchmark_give_the_same_leaks(spark, given, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = order((r["doc_id"], r["item_id"]) for r in lsa.find_leaks(given, benchmark).collect())
    monkeypatch.setattr(lsa, "SLICE", 120)
    assert order((r["doc_id"], r["item_id"]) for r in lsa.find_leaks(given, benchmark).collect()) == whole


def test_common_subsequence_counts():
    rng = random.Random(6)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(20)], [rng.randrange(6) for _ in range(30)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert lsa.common_subsequence(lsa.masks(a), len(a), b) == best[-1][-1]


def test_marginals_equal_enumeration():
    model = crf.Model(np.zeros(crf.BUCKETS, np.float32), np.array([[1.4, 0.5], [0.6, 1.2]]), -1.0)
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=n) for n in (5, 0, 1, 7)]
    for e, got in zip(texts, crf.marginals(model, texts)):
        weights = np.zeros((len(e), 2))
        for code in range(1 << len(e)):
            y = [code >> i & 1 for i in range(len(e))]
            score = np.exp(sum(e[i] for i in range(len(e)) if y[i]) + (model.start if y and y[0] else 0))
            for a, b in zip(y, y[1:]):
                score *= model.move[a, b]
            for i, s in enumerate(y):
                weights[i, s] += score
        assert np.allclose(got, weights[:, 1] / weights.sum(axis=1) if len(e) else [])


def test_toxicity_on_held_out_rows(spark):
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    documents, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = crf.tag(documents.select("doc_id", "text"), crf.train(documents, marks))
    rows = scored.join(marks, "doc_id").select("doc_id", "toxic", "score", crf.held_out(F.col("doc_id")).alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    bad, good = ([r["score"] for r in rows if r["held"] and r["toxic"] == y] for y in (1, 0))
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.8
    assert sum(g >= 0.5 for g in good) <= 0.05 * len(good)


def test_toxicity_of_awkward_rows(spark, docs, nothing, given, labels):
    model = crf.train(given, labels)
    scored = crf.tag(docs, model).collect()
    assert len(scored) == len(awkward()) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not (r["text"] or "").strip()}) == 1
    assert crf.tag(nothing, model).count() == 0
    assert crf.train(nothing, labels) is None and crf.train(given, labels.where("toxic = 0")) is None
    assert {r["score"] for r in crf.tag(docs, None).collect()} == {0.0}


def word_model(texts):
    """Probability of a word after another one, written out for dictionaries."""

    def off(counts):
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.0
        d = [min(max(k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.0, 0.0), k) for k in (1, 2, 3)]
        return {g: d[min(n, 3) - 1] for g, n in counts.items()}

    pairs = Counter(p for t in texts for p in zip([None, *t.split()], t.split()))
    stands = Counter(w for _, w in pairs)
    by_pair, by_word, size = off(pairs), off(stands), sum(stands.values())

    def p(v, w):
        single = (stands[w] - by_word.get(w, 0)) / size + sum(by_word.values()) / size / (len(stands) + 1)
        after = {g: n for g, n in pairs.items() if g[0] == v}
        total = sum(after.values())
        if not total:
            return single
        return (pairs[v, w] - by_pair.get((v, w), 0)) / total + sum(by_pair[g] for g in after) / total * single

    return p, stands


def test_kneser_ney_matches_loop(spark, monkeypatch):
    """Perplexities, thresholds and verdicts of a small corpus in many chunks and shards against the formulas."""
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", 150)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 100)
    rng = random.Random(3)
    words = [f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(4000)]
    texts, at = [], 0
    for _ in range(120):
        n = rng.choice([0, 1, 2, 5, 20, 60])
        texts.append(rng.choice(["", " "]) + "\n".join(words[at : at + n]))
        at += n
    texts += [None, "1234567890" * 100, "QWXZ KJHG " * 100, "w1 new w1 new2", texts[5], texts[5]]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    docs = spark.createDataFrame([(i, t, x, 7) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, n_words int")
    good = {i: rng.random() < 0.7 for i in range(0, 110)}
    labels = spark.createDataFrame([(i, int(g)) for i, g in good.items()] + [(1, None), (None, 1)], "doc_id long, quality int")
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    p, _ = word_model([texts[i] for i, g in good.items() if g and i not in held])
    want = {}
    for i, t in enumerate(texts):
        own = (t or "").split()
        want[i] = math.exp(-sum(math.log(p(v, w)) for v, w in zip([None, *own], own)) / len(own)) if own else None
    wide = {i: math.exp(2 / math.sqrt(max(1, len((t or "").split())))) for i, t in enumerate(texts)}
    judges = {}
    for i, g in good.items():
        if g and i in held and want[i] is not None:
            judges.setdefault(langs[i], []).append(want[i] / wide[i])
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and len(judges) == 3
    for i, r in got.items():
        assert (r["perplexity"] is None) == (want[i] is None)
        threshold = sorted(judges[langs[i]])[math.ceil(0.995 * len(judges[langs[i]])) - 1] * wide[i]
        assert math.isclose(r["threshold"], threshold, rel_tol=1e-9)
        if want[i] is not None:
            assert math.isclose(r["perplexity"], want[i], rel_tol=1e-9)
            if not math.isclose(want[i], threshold, rel_tol=1e-9):
                assert r["kept"] == (want[i] <= threshold)
        else:
            assert not r["kept"]


def test_kneser_ney_probabilities_sum_to_one():
    p, stands = word_model(["a b a c", "b a", "c c c a b b", ""])
    for v in (None, "a", "b", "c", "new"):
        assert math.isclose(sum(p(v, w) for w in (*stands, "unknown")), 1.0)


def test_quality_refuses_gibberish(spark, given, labels):
    gibberish = ["1234567890" * 100, "QWXZ KJHG " * 100]
    more = given.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(gibberish)], "doc_id long, text string, lang string"))
    assert kneser_ney.classify(more, labels).where("doc_id < 0 AND NOT kept").count() == 2


def test_quality_keeps_good_text(spark, given, labels, docs, nothing):
    rows = kneser_ney.classify(given, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.6 * len(bad)
    assert kneser_ney.classify(docs, labels).count() == len(awkward())
    assert kneser_ney.classify(nothing, labels).count() == 0
    assert kneser_ney.classify(docs, labels.where("false")).where("kept").count() == 0
