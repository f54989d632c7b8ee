"""Scoring with a trigram model kept in Elias-Fano tries.

The model is an interpolated one with Dirichlet priors; ``c`` counts training tokens:

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p2(w|v)   = (c(v w) + MU2 p1(w)) / (c(v) + MU2)
    p(w|u v)  = (c(u v w) + MU3 p2(w|v)) / (c(u v) + MU3)

An unseen word is one word; each text ends with an end token, which is predicted, and
starts after two start tokens, which are not. For every context the probabilities of all
words and the unseen one add up to 1.

Texts are packed into chunks. A chunk sends each of its different trigrams once, with
its training count, to the shard of the trigram's context. A shard adds up the counts,
compiles its part of the model into a trie (``eftrie``: smoothed probabilities in 16-bit
codes), maps it into memory and answers every chunk with the codes of its contexts and
trigrams; the chunk adds up its texts' scores. Nothing but the texts' own chunks grows
with a text, and nothing is broadcast but the number of words of each count, at most
sqrt(2 N) numbers, and the totals of split contexts. Contexts of two of the HOT most
frequent words may hold a large part of all trigrams: their trigrams are dealt by all
three words, and their totals, at most HOT * HOT numbers, are added up over the shards.

Defined cases: a null text is empty, an empty one has the end token only; words are
separated by white space, A to Z count as small; rows that agree in everything are
scored one by one; a null ``doc_id`` has the checksum of one space; without any training
text every word is unseen. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evenkeel.llm.common import text_col
from evenkeel.llm.eftrie import Trie, compiled, probability, quantised, starts_run
from evenkeel.session import scratch_path

MU2, MU3 = 2000.0, 6.0
FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 1_000_000  # training tokens of one shard, about
HOT = 512  # words; two of them make a split context
END = b"\n"  # no word has white space
UNKNOWN = -1


def held_out(doc_id) -> bool:
    return zlib.crc32((" " if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def put(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte and compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def take(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def put16(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u2")).view(np.uint8).reshape(-1, 2).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def take16(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, -1)
    return np.ascontiguousarray(raw.T).view("<u2").ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence."""
    return np.diff(values, prepend=0)


def by_number(values: np.ndarray, top: int) -> np.ndarray:
    """Stable order of numbers from 0 below ``top``; small ones are sorted digit by digit."""
    return np.argsort(values.astype(np.uint16) if top <= 1 << 16 else values, kind="stable")


def ranked(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of keys from 0 below ``top``, rising, and the place of each key among them."""
    bits = len(keys).bit_length()
    if top.bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    # sorting each key together with its place is faster than sorting places
    both = np.sort(keys << bits | np.arange(len(keys)))
    rising, at = both >> bits, both & ((1 << bits) - 1)
    first = starts_run(rising)
    place = np.empty(len(keys), dtype=np.int64)
    place[at] = np.cumsum(first) - 1
    return rising[first], place


def chunks(docs: DataFrame, shards: int, table: str) -> tuple[DataFrame, DataFrame]:
    """``chunk, ids, held, sizes, tokens, dealt`` and ``shard, chunk, words, counts``, written once.

    They are one table, bucketed by chunk, so that the texts are never shuffled.

    The texts of a chunk as numbers of its words, frequent words first, and its words
    with their training counts in parcels, one for each shard of the vocabulary.
    ``dealt`` has the shard of each word, so that the parcels' answers can be put in order.
    """
    id_type = docs.schema["doc_id"].dataType
    arrow = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("sizes", "tokens", "dealt")), ("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def packs(stream) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in stream:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().lower().split()
                if ids and size + len(words) >= CHUNK_TOKENS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                words.append(END)
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
        if ids:
            yield ids, texts

    def work(stream):
        for ids, texts in packs(stream):
            number: dict[bytes, int] = defaultdict(int)
            number.default_factory = number.__len__
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            tokens = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
            held = np.array([held_out(i) for i in ids])
            order = np.argsort(-np.bincount(tokens, minlength=len(number)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = list(number)
            words = [words[k] for k in order.tolist()]
            tokens = rank[tokens]
            counts = np.bincount(tokens, weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.int64)
            dealt = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % shards
            chunk = uuid4().int >> 65
            rows = [{"chunk": chunk, "ids": ids, "held": held.tolist(), "sizes": put(sizes), "tokens": put(tokens), "dealt": put(dealt), "shard": -1}]
            by_shard = by_number(dealt, shards)
            ends = np.searchsorted(dealt[by_shard], np.arange(shards + 1)).tolist()
            for s in range(shards):
                own = by_shard[ends[s] : ends[s + 1]]
                if len(own):
                    packed = zstandard.ZstdCompressor(level=3).compress(b" ".join(words[k] for k in own.tolist()))
                    rows.append({"chunk": chunk, "shard": s, "words": packed, "counts": put(counts[own])})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    rows = docs.select(docs["doc_id"].alias("doc_id"), text_col(docs).alias("text"))
    schema = f"chunk long, ids array<{id_type.simpleString()}>, held array<boolean>, sizes binary, tokens binary, dealt binary, shard int, words binary, counts binary"
    path = scratch_path(docs.sparkSession, table)
    rows.mapInArrow(work, schema).write.bucketBy(shards, "chunk").option("path", path).saveAsTable(table, format="parquet")
    made = docs.sparkSession.table(table)
    return made.where("shard = -1").select("chunk", "ids", "held", "sizes", "tokens", "dealt"), made.where("shard >= 0").select("shard", "chunk", "words", "counts")


def words_of(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b" ")


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of the training words in the order of their counts; ``rungs`` has, falling, each count and how many words have more or as many."""

    tokens: int
    words: int
    starts: int
    rungs: np.ndarray
    ends: np.ndarray

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each word number; the start token stands before every training text."""
        if not len(self.rungs):
            return np.zeros(len(ids), np.int64)
        found = self.rungs[np.minimum(np.searchsorted(self.ends, np.maximum(ids, 0), side="right"), len(self.rungs) - 1)]
        return np.where(ids == self.words, self.starts, np.where((ids < 0) | (ids > self.words), 0, found))

    def single(self, ids: np.ndarray) -> np.ndarray:
        return (self.count(ids) + 1) / (self.tokens + self.words + 1)


def vocabulary(parcels: DataFrame, shards: int) -> tuple[DataFrame, Vocabulary]:
    """``shard, word, id`` of the training words and what is known of their counts."""
    spark = parcels.sparkSession

    def added(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        for packed, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            for word, n in zip(words_of(packed), take(counts).tolist()):
                if n:
                    total[word] += n
        return pa.table({"word": pa.array(list(total), pa.binary()).cast(pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    path = scratch_path(spark, "words")
    counted = parcels.groupBy("shard").applyInArrow(added, "word string, n long").orderBy(F.col("n").desc(), "word")
    counted.select("word", "n", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    words = spark.read.parquet(path)
    part = F.shiftright("place", 33)
    sizes = {r["part"]: r["n"] for r in words.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row for each task
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    rungs = sorted((tuple(r) for r in words.groupBy("n").count().collect()), reverse=True)  # as many as counts differ
    end = words.where(F.col("word") == END.decode()).agg(F.max("n")).first()[0] or 0
    known = Vocabulary(sum(n * c for n, c in rungs), before, end, np.array([n for n, _ in rungs], np.int64), np.cumsum([c for _, c in rungs]))
    if known.words >= (1 << 32) - 2:
        raise ValueError("word numbers have 32 bits")
    first = spark.createDataFrame(offsets, "part long, first long")
    place = (F.col("first") + F.col("place") - F.shiftleft("part", 33)).alias("id")
    numbered = words.withColumn("part", part).join(F.broadcast(first), "part").select((F.crc32("word") % shards).cast("int").alias("shard"), "word", place)
    return numbered, known


def word_ids(parcels: DataFrame, numbered: DataFrame) -> DataFrame:
    """``chunk, shard, parts``: for each parcel the numbers of its words plus one; 0 for words that are not known.

    The shard is given as ``-1 - shard``, to tell these answers from those for trigrams.
    """

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        number = dict(zip(right.column("word").cast(pa.binary()).to_pylist(), right.column("id").to_pylist()))
        chunk, parts = left.column("chunk"), []
        for packed in left.column("words").to_pylist():
            words = words_of(packed)
            parts.append([put(np.fromiter(map(number.get, words, repeat(UNKNOWN)), np.int64, len(words)) + 1)])
        shard = pa.array([-1 - s for s in left.column("shard").to_pylist()], pa.int32())
        return pa.table({"chunk": chunk, "shard": shard, "parts": pa.array(parts, pa.list_(pa.binary()))})

    asked = parcels.select("shard", "chunk", "words")
    return asked.groupBy("shard").cogroup(numbered.groupBy("shard")).applyInArrow(look_up, "chunk long, shard int, parts array<binary>")


class Chunk:
    """One chunk's texts as word numbers, its contexts and its trigrams."""

    def __init__(self, row: dict, ids: dict[int, bytes], known: Vocabulary):
        self.sizes = take(row["sizes"])
        held = np.array(row["held"], dtype=bool)
        dealt = take(row["dealt"])
        number = np.empty(len(dealt), dtype=np.int64)
        number[np.argsort(dealt, kind="stable")] = np.concatenate([take(ids[s]) for s in sorted(ids)]) - 1
        # words by their places in the order of their numbers, the start token and the closing one come last
        by_id = np.argsort(number, kind="stable")
        place = np.empty_like(by_id)
        place[by_id] = np.arange(len(by_id))
        unknown, start, pad = int(np.count_nonzero(number < 0)), len(number), len(number) + 1
        self.numbers = np.append(number[by_id], [known.words, known.words + 1])
        self.words, self.texts = place[take(row["tokens"])], np.repeat(np.arange(len(self.sizes)), self.sizes)
        # every text with two start tokens before it and one that closes it
        n = len(self.sizes)
        first = np.cumsum(self.sizes) - self.sizes + 3 * np.arange(n)
        line = np.full(len(self.words) + 3 * n, start, dtype=np.int64)
        own = np.arange(len(self.words)) + 3 * self.texts + 2
        line[own] = self.words
        line[first + 2 + self.sizes] = pad
        self.before = line[own - 1]
        at = np.arange(len(self.words) + n) + 2 * np.repeat(np.arange(n), self.sizes + 1) + 2  # where a trigram ends
        w1, w2, w3 = line[at - 2], line[at - 1], line[at]
        train = np.repeat(~held, self.sizes + 1)
        usable = (w1 >= unknown) & (w2 >= unknown)
        top = len(self.numbers)
        keys, context = ranked(w2[usable] * top + w1[usable], top * top)
        self.w1, self.w2 = self.numbers[keys % top], self.numbers[keys // top]
        self.context = np.full(len(at), -1, dtype=np.int64)
        self.context[usable] = context
        seen = usable & (w3 >= unknown)
        grams, gram = ranked(self.context[seen] * top + w3[seen], max(1, len(keys)) * top)
        self.gram_context, self.w3 = grams // top, self.numbers[grams % top]
        self.counts = np.bincount(gram, weights=train[seen], minlength=len(grams)).astype(np.int64)
        self.gram = np.full(len(at), -1, dtype=np.int64)
        self.gram[seen] = gram
        self.split = (self.w1 < HOT) & (self.w2 < HOT)

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each context (-1 if split) and of each trigram."""

        def mixed(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))

        h = mixed(self.w2 << 32 | self.w1)
        of_gram = np.where(self.split[self.gram_context], mixed(h[self.gram_context] ^ self.w3.astype(np.uint64)), h[self.gram_context])
        return np.where(self.split, -1, (h % np.uint64(shards)).astype(np.int64)), (of_gram % np.uint64(shards)).astype(np.int64)

    def parcels(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, contexts and trigrams that go to it: those of a split context take the context along."""
        of_context, of_gram = self.dealt(shards)
        order = by_number(of_gram, shards)
        ends = np.searchsorted(of_gram[order], np.arange(shards + 1))
        by_context = by_number(of_context + 1, shards + 1)
        context_ends = np.searchsorted(of_context[by_context], np.arange(shards + 1))
        for s in range(shards):
            grams, whole = order[ends[s] : ends[s + 1]], by_context[context_ends[s] : context_ends[s + 1]]
            of = self.gram_context[grams]
            split = of[self.split[of]]  # rising, as the trigrams are; none of them is in ``whole``
            split = split[starts_run(split)]
            if len(whole) or len(grams):
                yield s, np.sort(np.append(whole, split)) if len(split) else whole, grams


def send(row: dict, chunk: Chunk, shards: int) -> Iterator[dict]:
    for s, contexts, grams in chunk.parcels(shards):
        place = np.searchsorted(contexts, chunk.gram_context[grams])
        data = [put(steps(chunk.w2[contexts])), put(chunk.w1[contexts]), put(np.bincount(place, minlength=len(contexts))), put(chunk.w3[grams]), put(chunk.counts[grams])]
        yield {"shard": s, "chunk": row["chunk"], "parts": data}


def answer(shard: int, parcels: list[tuple[int, list[bytes]]], known: Vocabulary) -> Iterator[dict]:
    """The shard's part of the model, and its codes for every chunk's contexts and trigrams."""
    got = []
    for _, parts in parcels:
        w2, w1, n, w3, count = (take(p) for p in parts)
        got.append((np.cumsum(w2), w1, n, w3, count))
    sizes = [(len(g[0]), len(g[3])) for g in got]
    w2, w1 = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    keys, context = np.unique(w2 << 32 | w1, return_inverse=True)
    of_gram = np.repeat(context, np.concatenate([g[2] for g in got]))
    grams, gram = np.unique(of_gram << 32 | np.concatenate([g[3] for g in got]), return_inverse=True)
    counts = np.bincount(gram, weights=np.concatenate([g[4] for g in got]), minlength=len(grams)).astype(np.int64)
    del got, of_gram  # only what differs is needed from here on
    gram_context, w3 = grams >> 32, grams & 0xFFFFFFFF
    total = np.bincount(gram_context, weights=counts, minlength=len(keys)).astype(np.int64)
    w1, w2 = keys & 0xFFFFFFFF, keys >> 32
    split = (w1 < HOT) & (w2 < HOT)
    in_model = (total > 0) & ~split
    rank = np.cumsum(in_model) - 1
    used = (counts > 0) & in_model[gram_context]
    codes = [np.full(len(keys), 0, np.uint16) for _ in range(2)]
    shares = np.full(len(grams), 65535, np.int64)
    if used.any():
        bigram, left = context_codes(w1[in_model], w2[in_model], total[in_model], known)
        share = quantised(counts[used] / (total[gram_context[used]] + MU3))
        trie = Trie.mapped(compiled(w1[in_model], w2[in_model], rank[gram_context[used]], w3[used], bigram, left, share))
        place, word = trie.find_contexts(w1, w2)
        below = trie.find_grams(place[gram_context], word[gram_context], w3)
        codes = [np.where(place >= 0, c[np.maximum(place, 0)], 0) for c in (trie.bigram, trie.left)]
        shares = np.where(below >= 0, trie.share[np.maximum(below, 0)], 65535).astype(np.int64)
    shares = np.where(split[gram_context], counts, shares)  # split contexts: the count itself
    seen = (total > 0) & ~split
    at_context = at_gram = 0
    for (chunk, _), (n_contexts, n_grams) in zip(parcels, sizes):
        c, g = context[at_context : at_context + n_contexts], gram[at_gram : at_gram + n_grams]
        at_context, at_gram = at_context + n_contexts, at_gram + n_grams
        yield {"chunk": chunk, "shard": shard, "parts": [put16(np.where(seen[c], codes[0][c], 65535)), put16(np.where(seen[c], codes[1][c], 0)), put(shares[g])], "w1": None, "w2": None, "total": None}
    for k in np.flatnonzero(split & (total > 0)):
        yield {"chunk": None, "shard": shard, "parts": None, "w1": int(w1[k]), "w2": int(w2[k]), "total": int(total[k])}


def context_codes(w1: np.ndarray, w2: np.ndarray, total: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes of p2(w2|w1) and of what a context leaves to the shorter one. ``total`` is the count of w1 w2."""
    return quantised((total + MU2 * known.single(w2)) / (known.count(w1) + MU2)), quantised(MU3 / (total + MU3))


def add_up(row: dict, chunk: Chunk, answers: dict[int, list[bytes]], totals: tuple[np.ndarray, np.ndarray], shards: int, known: Vocabulary) -> dict:
    """Scores of a chunk's texts from the shards' codes."""
    n_contexts, n_grams = len(chunk.w1), len(chunk.w3)
    # the last entry, also found as -1, stands for a context or trigram that was not sent
    bigram, left = np.full(n_contexts + 1, 65535, np.uint16), np.zeros(n_contexts + 1, np.uint16)
    shares = np.full(n_grams + 1, 65535, np.int64)
    for s, contexts, grams in chunk.parcels(shards):
        b, rest, share = answers[s]
        whole = ~chunk.split[contexts]
        bigram[contexts[whole]], left[contexts[whole]] = take16(b)[whole], take16(rest)[whole]
        shares[grams] = take(share)
    split = np.flatnonzero(chunk.split)
    if len(split):
        keys, sums = totals
        key = chunk.w2[split] << 32 | chunk.w1[split]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        total = np.where(keys[at] == key, sums[at], 0) if len(keys) else np.zeros(len(split), np.int64)
        codes = context_codes(chunk.w1[split], chunk.w2[split], total, known)
        bigram[split], left[split] = np.where(total > 0, codes[0], 65535), np.where(total > 0, codes[1], 0)
        of_split = np.flatnonzero(chunk.split[chunk.gram_context])
        place = np.searchsorted(split, chunk.gram_context[of_split])
        shares[of_split] = quantised(shares[of_split] / (total[place] + MU3))
    # the context that ends with a token has the token's bigram probability
    w, counts = chunk.words, known.count(chunk.numbers)
    here = np.arange(len(w)) + chunk.texts
    following = chunk.context[here + 1]  # the next trigram's context is (before, w); every text has one trigram more
    single = known.single(chunk.numbers)
    p1 = single[w]
    unseen = MU2 * p1 / (counts[chunk.before] + MU2)
    p2 = np.where(bigram[following] != 65535, probability(bigram[following]), unseen)
    rest, share = probability(left[chunk.context[here]]), probability(shares[chunk.gram[here]].astype(np.uint16))
    first = np.cumsum(chunk.sizes) - chunk.sizes
    score = np.add.reduceat(np.log10(share + rest * p2), first)
    return {
        "doc_id": row["ids"], "held_out": row["held"], "n_tokens": chunk.sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64)[w], first),
        "train_tokens": np.full(len(first), known.tokens), "base_score": np.add.reduceat(np.log10(single)[w], first), "score": score,
    }


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row for each row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"chunks_{uuid4().hex}"
    packed, parcels = chunks(docs, partitions, table)
    numbered, known = vocabulary(parcels, partitions)
    path = scratch_path(spark, "numbers")
    word_ids(parcels, numbered).write.parquet(path)
    ids = spark.read.parquet(path)
    shards = max(partitions, -(-known.tokens // SHARD_TOKENS))

    def opened(left: pa.Table, right: pa.Table):
        parts = {-1 - s: p[0] for s, p in zip(right.column("shard").to_pylist(), right.column("parts").to_pylist()) if s < 0}
        for row in left.to_pylist():  # one row
            yield row, Chunk(row, parts, known)

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r for row, chunk in opened(left, right) for r in send(row, chunk, shards)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("parts", pa.list_(pa.binary()))]))

    sent = packed.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(ship, "shard int, chunk long, parts array<binary>")

    def reply(table: pa.Table) -> pa.Table:
        parcels = list(zip(table.column("chunk").to_pylist(), table.column("parts").to_pylist()))
        rows = list(answer(table.column("shard")[0].as_py(), parcels, known))
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("parts", pa.list_(pa.binary())), ("w1", pa.int64()), ("w2", pa.int64()), ("total", pa.int64())]))

    path = scratch_path(spark, "answers")
    sent.groupBy("shard").applyInArrow(reply, "chunk long, shard int, parts array<binary>, w1 long, w2 long, total long").write.parquet(path)
    answers = spark.read.parquet(path)
    split = answers.where("chunk IS NULL").groupBy("w1", "w2").agg(F.sum("total").alias("total")).collect()  # at most HOT * HOT rows
    keys = np.array([r["w2"] << 32 | r["w1"] for r in split], np.int64)
    order = np.argsort(keys)
    totals = keys[order], np.array([r["total"] for r in split], np.int64)[order]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {s: p for s, p in zip(right.column("shard").to_pylist(), right.column("parts").to_pylist()) if s >= 0}
        out = [add_up(row, chunk, got, totals, shards, known) for row, chunk in opened(left, right)]
        types = [to_arrow_type(id_type), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        return pa.concat_tables([pa.table([pa.array(o[c], t) for c, t in zip(names, types)], names=names) for o in out])

    both = answers.where("chunk IS NOT NULL").select("chunk", "shard", "parts").unionByName(ids)
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    path = scratch_path(spark, "scores")
    packed.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema).write.parquet(path)
    spark.sql(f"DROP TABLE {table}")
    return spark.read.parquet(path)
