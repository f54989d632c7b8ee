"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of words.

The model is trained on the documents labelled good and predicts each word from the one
before; a text's first word follows a start token. With ``n`` the trained count of a pair
of words, ``D`` the three modified discounts of the pairs and ``d`` those of the
continuation counts ``t`` (in how many different contexts a word stands):

    p1(w)   = max(t(w) - d, 0) / T + rest / V        rest: what the discounts leave; V: known words and one unknown
    p(w|v)  = max(n(v w) - D, 0) / n(v) + rest(v) p1(w),  and p1(w) after an unknown v

All counts cover the whole trusted text, so what is gathered grows with it. Texts are
packed into chunks. A chunk reduces its texts to different pairs with their trained
counts and sends them, as 56-bit hashes, to the pairs' shards. A shard adds the counts up
and answers every chunk; it names one chunk of each trained pair its owner. In the same
way the owners' sums for each word go to the words' shards and come back added up. Then a
chunk has all it needs to add up its texts' log probabilities. Hashes are dealt evenly and
a chunk sends each one once, so neither a frequent word nor a hot source makes a large
shard. Nothing is broadcast but the discounts and totals. Pairs and words are sent in
several rounds, each to some of the shards, and the files a round has shuffled go with it;
so the disk holds one round's share of them beside the chunks.

A fifth of the trusted documents, by the checksum of ``doc_id``, is not trained on. Their
perplexities give the thresholds, a quantile for each language, as a model knows its own
training text too well; short texts, whose mean varies more, get a wider one. In a trial of
these formulas on sf0.1 (703 such documents, which also set the thresholds) 99.1 % of them
were kept and 21 % of those labelled bad; a quantile of 0.98 kept 97.7 % and 16 %.

Defined cases: a text without a word (null, empty, white space) has no perplexity and is
not kept; words are separated by white space; a null language is a language of its own; a
language without held-out trusted documents has the quantile of all; without any, nothing
is kept; without trained text there is no perplexity; labels that are null don't count,
repeated labels count once (good only if all are); rows with one ``doc_id`` share its
label. ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evenkeel.llm.common import text_col
from evenkeel.session import cut_lineage, scratch_path

QUANTILE = 0.995
SHORT = 2.0  # nats that one word's loss may differ from the mean; over the root of the number of words
FOLDS = 5  # one of them is held out
CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 2_000_000  # tokens whose pairs one shard gets, about
PAIR_ROUNDS, WORD_ROUNDS, LAST_ROUNDS = 2, 2, 2  # jobs that pairs and words are sent in, by shard, and that chunks are finished in: what one shuffles is gone before the next
KEY_BITS = 56
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
START_KEY = np.uint64(1)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATS = 7  # how many are 1, 2, 3, 4, at least 3, not 0; their sum


def put(values: np.ndarray) -> bytes:
    """Numbers byte by byte and compressed; bytes that are always 0 cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def take(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def put_keys(keys: np.ndarray) -> bytes:
    """Keys as differences, which are small where keys rise."""
    return put(np.diff(keys, prepend=np.uint64(0)) & KEY_MASK)


def take_keys(data: bytes) -> np.ndarray:
    return np.cumsum(take(data), dtype=np.uint64) & KEY_MASK


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - KEY_BITS)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + w
    for by in (0xD6E8FEB86659FD93, 0xCA5A826395121157):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - KEY_BITS)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards hold ranges of keys, so sorted keys lie shard by shard."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards)) >> np.uint64(32)


def chunks(docs: DataFrame, buckets: int, table: str) -> DataFrame:
    """``chunk, ids, langs, n_tokens, sizes, tokens, words``, written once and bucketed by chunk: texts are never shuffled."""
    types = {c: docs.schema[c].dataType for c in ("doc_id", "lang")}
    arrow = pa.schema([
        ("chunk", pa.int64()), ("ids", pa.list_(to_arrow_type(types["doc_id"]))), ("langs", pa.list_(to_arrow_type(types["lang"]))),
        ("n_tokens", pa.int64()), *((c, pa.binary()) for c in ("sizes", "tokens", "words")),
    ])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[str, int] = defaultdict(int)
        number.default_factory = number.__len__
        sizes = np.array([len(words) for _, _, words in rows], np.int64)
        tokens = np.fromiter((number[w] for _, _, words in rows for w in words), np.int64, int(sizes.sum()))
        keys, same = np.unique(np.fromiter(map(word_key, number), np.uint64, len(number)), return_inverse=True)
        tokens = same[tokens]
        order = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")  # frequent words have small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        row = {"chunk": uuid4().int >> 65, "ids": [r[0] for r in rows], "langs": [r[1] for r in rows], "n_tokens": len(tokens)}
        return pa.RecordBatch.from_pylist([{**row, "sizes": put(sizes), "tokens": put(rank[tokens]), "words": put_keys(keys[order])}], schema=arrow)

    def work(stream):
        rows, size = [], 0
        for batch in stream:
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                if rows and size + len(words) > CHUNK_TOKENS:
                    yield packed(rows)
                    rows, size = [], 0
                rows.append((doc_id, lang, words))
                size += len(words)
        if rows:
            yield packed(rows)

    schema = f"chunk long, ids array<{types['doc_id'].simpleString()}>, langs array<{types['lang'].simpleString()}>, n_tokens long, sizes binary, tokens binary, words binary"
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), text_col(docs).alias("text"))
    path = scratch_path(docs.sparkSession, table)
    rows.mapInArrow(work, schema).write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(table, format="parquet")
    return docs.sparkSession.table(table)


class Chunk:
    """One chunk's words and its different pairs, sorted by key, with their trained counts."""

    def __init__(self, row: dict, trained: list[int]):
        self.sizes = take(row["sizes"]).astype(np.int64)
        self.words = take_keys(row["words"])
        w = take(row["tokens"]).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(w)
        before[1:] = w[:-1]
        start = len(self.words)
        before[self.first[self.sizes > 0]] = start
        codes, pair, counts = np.unique(before * (start + 1) + w, return_inverse=True, return_counts=True)
        del before, counts
        in_training = np.zeros(len(self.sizes), bool)
        in_training[trained] = True
        trained_counts = np.bincount(pair[np.repeat(in_training, self.sizes)], minlength=len(codes))
        self.v, self.w = codes // (start + 1), codes % (start + 1)
        keys = pair_key(np.append(self.words, START_KEY)[self.v], self.words[self.w])
        order = np.argsort(keys, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.v, self.w, self.keys, self.counts, self.pair = self.v[order], self.w[order], keys[order], trained_counts[order], rank[pair]

    @property
    def word_order(self) -> np.ndarray:
        """Words and the start token, which is a context like a word, by key."""
        return np.argsort(np.append(self.words, START_KEY), kind="stable")

    def word_sums(self, owned: np.ndarray, totals: np.ndarray) -> list[np.ndarray]:
        """Of the owned pairs, for each word: count as a context, successors seen once, twice, more often, and contexts it stands in."""
        n, v, w, size = totals[owned], self.v[owned], self.w[owned], len(self.words) + 1
        total = np.zeros(size, np.int64)
        np.add.at(total, v, n)
        return [total, *(np.bincount(v[c], minlength=size) for c in (n == 1, n == 2, n >= 3)), np.bincount(w, minlength=size)]


def parcels(chunk: int, keys: np.ndarray, values: list[np.ndarray], shards: int, rounds: int = 1, now: int = 0) -> Iterator[dict]:
    """Sorted keys with their values, cut by shard; of several rounds each has its own shards."""
    own = shard_of(keys, shards)
    begins = np.flatnonzero(np.diff(own, prepend=np.uint64(shards)))
    for a, b in zip(begins, [*begins[1:], len(keys)]):
        if own[a] % rounds != now:
            continue
        yield {"shard": int(own[a]), "chunk": chunk, "keys": put_keys(keys[a:b]), "parts": [put(v[a:b]) for v in values]}


def stats_of(values: np.ndarray) -> list[int]:
    return [*(int((values == k).sum()) for k in (1, 2, 3, 4)), int((values >= 3).sum()), int((values > 0).sum()), int(values.sum())]


def added_up(table: pa.Table) -> pa.Table:
    """A shard's sums for each chunk's keys, one owner for each key that has any, and what the last column's sums look like."""
    shard, chunk = table.column("shard")[0].as_py(), table.column("chunk").to_pylist()
    got = []
    for packed, parts in zip(table.column("keys").to_pylist(), table.column("parts").to_pylist()):
        keys, values = take_keys(packed), [take(p).astype(np.int64) for p in parts]
        some = np.flatnonzero(np.any(values, axis=0))
        got.append((packed, keys[some], [v[some] for v in values]))
    known, first, same = np.unique(np.concatenate([g[1] for g in got]), return_index=True, return_inverse=True)
    sums = []
    for k in range(len(got[0][2])):
        total = np.zeros(len(known), np.int64)
        np.add.at(total, same, np.concatenate([g[2][k] for g in got]))
        sums.append(total)
    ends = np.cumsum([len(g[1]) for g in got])
    owner = np.searchsorted(ends, first, side="right")
    rows = [{"chunk": None, "shard": shard, "parts": None, "stats": stats_of(sums[-1])}]
    for k, (packed, _, _) in enumerate(got):
        keys = take_keys(packed)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        answer = [np.where(found, s[at], 0) if len(known) else np.zeros(len(keys), np.int64) for s in (*sums, owner == k)]
        rows.append({"chunk": chunk[k], "shard": shard, "parts": [put(a) for a in answer], "stats": None})
    return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("parts", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))]))


def discounts(stats: list[int]) -> np.ndarray:
    """The three modified discounts, from how many keys have each small count."""
    c = [0, *stats[:4]]
    y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.0
    return np.array([min(max(k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.0, 0.0), float(k)) for k in (1, 2, 3)])


def discounted(n: np.ndarray, by: np.ndarray) -> np.ndarray:
    return n - np.where(n > 0, by[np.clip(n, 1, 3) - 1], 0.0)


@dataclass(frozen=True)
class Model:
    """What all chunks need to know: discounts of pairs and of continuations, and what the latter leave to each word."""

    pairs: np.ndarray
    words: np.ndarray
    continuations: int
    uniform: float

    @staticmethod
    def of(pairs: list[int], words: list[int]) -> Model | None:
        if not words[6]:
            return None
        d = discounts(words)
        rest = float(np.dot(d, [words[0], words[1], words[4]])) / words[6]
        return Model(discounts(pairs), d, words[6], rest / (words[5] + 1))

    def logs(self, chunk: Chunk, n: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """Log probability of each of the chunk's pairs, from its count and its words' sums."""
        total, one, two, more, stands = words
        single = discounted(stands, self.words) / self.continuations + self.uniform
        share = np.maximum(total, 1)
        rest = np.where(total > 0, (one * self.pairs[0] + two * self.pairs[1] + more * self.pairs[2]) / share, 1.0)
        return np.log(discounted(n, self.pairs) / share[chunk.v] + rest[chunk.v] * single[chunk.w])


def good_ids(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.where("quality = 1").select("doc_id")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def write_and_clean(rows: DataFrame, path: str) -> None:
    """Appends the rows to a Parquet folder; files shuffled for it go at once, not when the driver happens to collect its garbage."""
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        rows.write.mode("append").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def joined(answers: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
    """Answers of all shards, in the order of the keys."""
    return [np.concatenate([take(parts[k]) for _, parts in sorted(answers)]).astype(np.int64) for k in range(len(answers[0][1]))]


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, perplexity`` of every row of ``docs``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quality_chunks_{uuid4().hex}"
    packed = chunks(docs, partitions, table)
    tokens = packed.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(partitions, -(-tokens // SHARD_TOKENS))
    placed = packed.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
    trained = placed.join(good_ids(labels).where(~held_out(F.col("doc_id"))), "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    notes = "chunk long, round int, shard int, parts array<binary>, places array<int>"
    path = scratch_path(spark, "trained")
    trained.selectExpr("chunk", "0 AS round", "0 AS shard", "CAST(NULL AS array<binary>) AS parts", "places").write.parquet(path)
    known = spark.read.schema(notes).parquet(path)

    def opened(left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, Chunk, dict]]:
        answers = defaultdict(list)
        places: list[int] = []
        for r in right.to_pylist():
            if r["round"]:
                answers[r["round"]].append((r["shard"], r["parts"]))
            else:
                places = r["places"]
        for row in left.to_pylist():  # one row
            yield row, Chunk(row, places), {k: joined(a) for k, a in answers.items()}

    sent = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("parts", pa.list_(pa.binary()))])

    def send_pairs(left: pa.Table, right: pa.Table, now: int) -> pa.Table:
        return pa.Table.from_pylist([p for row, c, _ in opened(left, right) for p in parcels(row["chunk"], c.keys, [c.counts], shards, PAIR_ROUNDS, now)], schema=sent)

    def send_words(left: pa.Table, right: pa.Table, now: int) -> pa.Table:
        out = []
        for row, c, answers in opened(left, right):
            if not len(c.keys):
                continue
            totals, owned = answers[1]
            order = c.word_order
            out += parcels(row["chunk"], np.append(c.words, START_KEY)[order], [s[order] for s in c.word_sums(owned > 0, totals)], shards, WORD_ROUNDS, now)
        return pa.Table.from_pylist(out, schema=sent)

    def exchange(send, notes_so_far: DataFrame, nr: int, rounds: int) -> tuple[DataFrame, list[int]]:
        """The answers as notes, and the stats of all shards together."""
        path = scratch_path(spark, "answers")

        def of_round(now: int):
            return lambda left, right: send(left, right, now)

        for now in range(rounds):
            asked = packed.groupBy("chunk").cogroup(notes_so_far.groupBy("chunk")).applyInArrow(of_round(now), "shard int, chunk long, keys binary, parts array<binary>")
            write_and_clean(asked.groupBy("shard").applyInArrow(added_up, "chunk long, shard int, parts array<binary>, stats array<long>"), path)
        answers = spark.read.parquet(path)
        stats = answers.where("chunk IS NULL").agg(*(F.sum(F.col("stats")[k]) for k in range(STATS))).first()
        as_notes = answers.where("chunk IS NOT NULL").selectExpr("chunk", f"{nr} AS round", "shard", "parts", "CAST(NULL AS array<int>) AS places")
        return as_notes, [s or 0 for s in stats]

    pairs, pair_stats = exchange(send_pairs, known, 1, PAIR_ROUNDS)
    words, word_stats = exchange(send_words, known.unionByName(pairs), 2, WORD_ROUNDS)
    model = Model.of(pair_stats, word_stats)
    types = [to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(docs.schema["lang"].dataType), pa.int64(), pa.float64()]
    names = ("doc_id", "lang", "n_words", "perplexity")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, c, answers in opened(left, right):
            values = np.full(len(c.sizes), np.nan)
            if model is not None and len(c.keys):
                sums = []
                order = c.word_order
                for s in answers[2][:-1]:
                    by_word = np.empty_like(s)
                    by_word[order] = s
                    sums.append(by_word)
                some = c.sizes > 0
                loss = np.add.reduceat(model.logs(c, answers[1][0], sums)[c.pair], c.first[some])
                values[some] = np.exp(-loss / c.sizes[some])
            columns = (row["ids"], row["langs"], c.sizes, [None if np.isnan(v) else v for v in values.tolist()])
            out.append(pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names))
        return pa.concat_tables(out)

    every = known.unionByName(pairs).unionByName(words)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang {docs.schema['lang'].dataType.simpleString()}, n_words long, perplexity double"
    path = scratch_path(spark, "perplexities")
    for now in range(LAST_ROUNDS):
        some = F.pmod("chunk", F.lit(LAST_ROUNDS)) == now
        write_and_clean(packed.where(some).groupBy("chunk").cogroup(every.where(some).groupBy("chunk")).applyInArrow(finish, schema), path)
    spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(schema).parquet(path)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, kept``: one row for each row of ``docs``."""
    scored = perplexities(docs, labels)
    width = F.exp(SHORT / F.sqrt(F.greatest("n_words", F.lit(1))))
    judges = scored.where(F.col("perplexity").isNotNull() & held_out(F.col("doc_id"))).join(good_ids(labels), "doc_id", "left_semi")
    top = F.percentile_approx(F.col("perplexity") / width, QUANTILE, 10000)
    by_lang = cut_lineage(judges.groupBy("lang").agg(top.alias("own")))
    every = judges.agg(top.alias("every")).first()["every"]
    own = scored.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(every).cast("double")) * width
    return own.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
