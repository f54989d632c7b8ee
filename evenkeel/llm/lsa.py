"""Benchmark decontamination by latent semantic retrieval.

Texts become lists of word numbers in the benchmark's vocabulary (other words can't
match an item). A distributed randomised SVD of TF-IDF passages gives latent vectors;
each window of a document is compared with items by cosine, and the candidates are
checked by the longest common subsequence of words with the window's surroundings. Items
longer than a window are cut into parts of a window's length, any of which makes the item
a candidate; short ones are compared with windows of half the length. Items of whose
words too few are in the document at all can't pass the check and are left out before. From
SURE of an item's words on it is a leak; from MAYBE on it is one if the item's end, its
answer, is there as well.

The SVD is that of all documents' passages and the items. Its Gram matrix, the sums over
passages of the products of two words' weights, is added up in one pass over the texts and
kept in blocks of rows, so its size depends on the benchmark's words and not on the corpus;
the passes of the SVD read the blocks. Document frequencies count all documents, and every
window of every document is searched. A benchmark of more than SLICE items or SLICE_WORDS words is worked
through in slices by a hash of the items, so that what is sent to the executors stays
bounded (an item is never cut, so one of more words makes its slice that much larger).

Defined cases: words are runs of letters, digits and underscores in lower case; null
and empty texts have no windows; items without words are never found, those of fewer
than five words only as a whole; equal items are each reported; an empty benchmark or
table gives no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import batches, doc_key, free_name, keyed, texts_of
from evenkeel.session import scratch_path

LATENT = 200
STEP, STEPS = 8, 4  # words between windows, steps in a window
SHORT_STEPS, SHORT = 2, 9  # windows for items of so many words, which lie in one of them wherever they begin
COSINE = 0.4
COMMON, COMMON_WEIGHT = 0.05, 0.05  # words in more than this share of the documents keep little weight
SURE, MAYBE, ANSWER = 0.8, 0.6, 0.8
SLICE, SLICE_WORDS = 5000, 250_000  # items and words of items worked on at once
GRAM_TASKS = 64  # at least; each adds up its own products, so tasks do not grow with the corpus
GRAM_PARTS = 6  # tasks that multiply with the Gram matrix, each giving one thin matrix to the driver
DENSE = 4_000_000  # numbers of a block of the Gram matrix
DENSE_WORDS = 6000  # up to so many words a task adds up in a full matrix
PAIRS = 1_000_000  # products added up at once
POWER_STEPS = 2
TOKEN = re.compile(r"\w+")


@dataclass
class Items:
    """The benchmark as lists of word numbers."""

    ids: list
    words: dict[str, int]
    lists: list[list[int]]
    masks: list[dict[int, int]] = field(default_factory=list)
    answers: list[dict[int, int]] = field(default_factory=list)

    def prepare(self) -> Items:
        self.masks = [masks(x) for x in self.lists]
        self.answers = [masks(answer(x)) for x in self.lists]
        return self


def read_items(rows: list) -> Items:
    vocabulary: dict[str, int] = {}
    ids, lists = [], []
    for item_id, text in rows:
        words = TOKEN.findall((text or "").lower())
        if words:
            ids.append(item_id)
            lists.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    return Items(ids, vocabulary, lists)


def answer(item: list[int]) -> list[int]:
    """The item's end: a fifth of it, three words at least."""
    return item[-max(3, len(item) // 5) :]


def masks(words: list[int]) -> dict[int, int]:
    """For each word the bits of its places."""
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(places: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; one addition a word."""
    return matched(filter(None, map(places.get, text)), size)


def matched(found: Iterable[int], size: int) -> int:
    """The same from the bits of the words' places, those of words without any left out."""
    row = full = (1 << size) - 1
    for m in found:
        u = row & m
        row = (row + u) | (row - u)  # what is carried beyond the last bit changes none below
    return size - (row & full).bit_count()


def word_numbers(rows: DataFrame, items: Items) -> DataFrame:
    """``doc_id, key, ids``: each text as 32-bit word numbers, -1 for words of no item."""
    words = items.words

    def work(stream):
        number, none = words.get, repeat(-1)
        for batch in batches(stream):
            coded = [np.fromiter(map(number, TOKEN.findall(t.lower()), none), "<i4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(coded, pa.binary())], names=["doc_id", "key", "ids"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(work, f"doc_id {id_type}, key long, ids binary")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's words one after the other, with their row and their place in it."""
    lists = batch.column("ids").to_pylist()
    sizes = np.array([len(x) // 4 for x in lists], dtype=np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.frombuffer(b"".join(lists), "<i4").astype(np.int64), np.repeat(np.arange(len(lists)), sizes), place


def document_frequency(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and the number of documents."""

    def count(stream):
        total, docs = np.zeros(size, dtype=np.int64), 0
        for batch in batches(stream):
            ids, row, _ = flat(batch)
            found = np.unique(row[ids >= 0] * size + ids[ids >= 0])
            total += np.bincount(found % size, minlength=size)
            docs += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *used.tolist()], pa.int32()), "n": pa.array([docs, *total[used].tolist()], pa.int64())})

    rows = coded.select("ids").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, docs = np.zeros(size), 0
    for word, n in rows:
        if word < 0:
            docs = n
        else:
            out[word] = n
    return out, docs


def passage_matrix(ids: np.ndarray, table: np.ndarray, length: int = STEPS) -> np.ndarray:
    """Sums of ``table``'s rows over every window of ``length`` steps of the text."""
    steps = -(-len(ids) // STEP)
    sums = np.zeros((steps, table.shape[1]), dtype=table.dtype)
    at = np.flatnonzero(ids >= 0)
    if len(at):
        step = at // STEP
        first = np.flatnonzero(np.diff(step, prepend=-1))
        nth = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))  # which of its step's words
        sums[step[first]] = table[ids[at[first]]]
        for k in range(1, nth.max() + 1):
            some = np.flatnonzero(nth == k)
            sums[step[some]] += table[ids[at[some]]]
    windows = max(1, steps - length + 1)
    out = sums[:windows].copy()
    for k in range(1, min(length, steps)):
        out += sums[k : k + windows]
    return out


def products(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each two words of a passage (the lower number first, a word with itself too) ``first * size + second`` and the product of their weights, passages having length one."""
    size = len(idf)
    ids, row, place = flat(batch)
    passage = np.cumsum(place % (STEP * STEPS) == 0) - 1
    known = ids >= 0
    codes, times = np.unique(passage[known] * size + ids[known], return_counts=True)
    if not len(codes):
        return
    passage, word = codes // size, codes % size
    x = times * idf[word]
    x /= np.sqrt(np.bincount(passage, x * x))[passage] + 1e-12
    for apart in range(STEP * STEPS):
        end = len(word) - apart
        both = np.flatnonzero(passage[:end] == passage[apart:])
        if not len(both):
            return
        yield word[both] * size + word[both + apart], x[both] * x[both + apart]


def added(codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its values."""
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(at, np.concatenate(values), len(every))


def gram_matrix(coded: DataFrame, idf: np.ndarray) -> DataFrame:
    """``block, codes, sums``: the upper half of the passages' Gram matrix, in blocks of rows of at most DENSE numbers (one row at least)."""
    size = len(idf)
    per_block = max(1, DENSE // size) * size
    columns = "block long, codes binary, sums binary"

    def blocks(codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        of = codes // per_block
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        ends = [*begin[1:], len(codes)]
        cut = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(begin, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(of[begin], pa.int64()), cut(codes % per_block, "<i4" if per_block < 2**31 else "<i8"), cut(sums, "<f4")], names=["block", "codes", "sums"])

    def one_task(stream):
        full = np.zeros(size * size) if size <= DENSE_WORDS else None
        codes, sums, held = [], [], 0
        for batch in batches(stream):
            for c, v in products(batch, idf):
                if full is not None:
                    np.add.at(full, c, v)
                    continue
                codes.append(c)
                sums.append(v)
                held += len(c)
                if held > PAIRS + 2 * len(codes[0]):  # the first holds what is added up already
                    c, v = added(codes, sums)
                    codes, sums, held = [c], [v], len(c)
        if full is not None:
            used = np.flatnonzero(full)
            yield blocks(used, full[used])
        elif codes:
            yield blocks(*added(codes, sums))

    def one_block(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(per_block), None
        for batch in rows:
            for block, c, v in zip(*(batch.column(x).to_pylist() for x in ("block", "codes", "sums"))):
                total[np.frombuffer(c, "<i4" if per_block < 2**31 else "<i8")] += np.frombuffer(v, "<f4")
        used = np.flatnonzero(total)
        yield blocks(used + block * per_block, total[used])

    tasks = max(GRAM_TASKS, coded.sparkSession.sparkContext.defaultParallelism)
    sums = coded.select("ids").coalesce(tasks).mapInArrow(one_task, columns)
    return sums.groupBy("block").applyInArrow(one_block, columns)


def latent_space(coded: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """Weights from words to latent dimensions: a randomised SVD of the TF-IDF passages of all documents.

    Each pass multiplies the passages' Gram matrix with a thin matrix.
    """
    size = len(items.words)
    wide = min(LATENT + 8, size)
    per_block = max(1, DENSE // size) * size
    path = scratch_path(coded.sparkSession, "gram")
    gram_matrix(coded, idf).write.parquet(path)
    stored = coded.sparkSession.read.parquet(path)
    if stored.rdd.getNumPartitions() > GRAM_PARTS:
        stored = stored.coalesce(GRAM_PARTS)

    def gram(basis: np.ndarray) -> np.ndarray:
        def work(stream):
            total = np.zeros((size, basis.shape[1]))
            for batch in batches(stream, 1):
                block, c, v = (batch.column(x)[0].as_py() for x in ("block", "codes", "sums"))
                half = np.zeros(per_block, dtype=np.float32)
                half[np.frombuffer(c, "<i4" if per_block < 2**31 else "<i8")] = np.frombuffer(v, "<f4")
                at, half = block * (per_block // size), half.reshape(-1, size)
                rows = min(len(half), size - at)
                total[at : at + rows] += half[:rows] @ basis
                np.fill_diagonal(half[:, at:], 0)  # the diagonal belongs to one of the halves
                total += half[:rows].T @ basis[at : at + rows]
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

        total = np.zeros((size, basis.shape[1]))
        for row in stored.mapInArrow(work, "part binary").toLocalIterator(prefetchPartitions=False):  # one of GRAM_PARTS at a time
            total += np.frombuffer(row["part"]).reshape(total.shape)
        for x in items.lists:
            add_passage(total, np.array(x), idf, basis)
        return total

    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((size, wide)))[0]
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(gram(basis))[0]
    _, turn = np.linalg.eigh(basis.T @ gram(basis))
    return (idf[:, None] * (basis @ turn[:, ::-1][:, :LATENT])).astype(np.float32)


def add_passage(total: np.ndarray, ids: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> None:
    """Adds x (x' basis) for the TF-IDF vector x of one passage, of length one."""
    words, times = np.unique(ids[ids >= 0], return_counts=True)
    if len(words):
        x = times * idf[words]
        x = x / (np.linalg.norm(x) + 1e-12)
        total[words] += np.outer(x, x @ basis[words])


def weights(frequency: np.ndarray, docs: int) -> np.ndarray:
    """Inverse document frequency; very common words, which say little, keep a small part of it."""
    idf = np.log((docs + 1) / (frequency + 1)) + 0.01
    return np.where(frequency > max(5, COMMON * docs), COMMON_WEIGHT * idf, idf)


@dataclass
class Parts:
    """Items in pieces of a window's length: where each begins in its item, and its latent vector of length one."""

    item: np.ndarray
    offset: np.ndarray
    short: np.ndarray
    latent: np.ndarray
    words: np.ndarray  # of all items, one after the other
    starts: np.ndarray
    least: np.ndarray  # words of each item that a document must have for the check to pass

    @staticmethod
    def of(lists: list[list[int]], table: np.ndarray) -> Parts:
        width = STEP * STEPS
        cut = [(j, at) for j, x in enumerate(lists) for at in dict.fromkeys([*range(0, max(len(x) - width, 0), width), max(len(x) - width, 0)])]
        latent = np.stack([table[lists[j][at : at + width]].sum(axis=0) for j, at in cut])
        latent /= np.linalg.norm(latent, axis=1, keepdims=True) + 1e-6
        item, offset = np.array(cut).T
        sizes = np.array([len(x) for x in lists])
        least = np.where(sizes < 5, sizes, np.ceil(MAYBE * sizes - 1e-9))
        return Parts(item, offset, sizes[item] <= SHORT, latent.astype(np.float32), np.concatenate(lists), np.cumsum(sizes) - sizes, least)

    def possible(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Parts of the items that have enough of their words in the text; no common subsequence is longer."""
        present = np.zeros(size, dtype=np.int32)
        present[ids[ids >= 0]] = 1
        return np.flatnonzero((np.add.reduceat(present[self.words], self.starts) >= self.least)[self.item])


def candidates(ids: np.ndarray, table: np.ndarray, parts: Parts) -> list[tuple[int, int, int]]:
    """First words of windows, items, and where the item's part begins, for parts whose cosine with the window in the latent space is high enough."""
    some = parts.possible(ids, len(table)) if len(ids) else []
    out = []
    for length, own in ((STEPS, False), (SHORT_STEPS, True)) if len(some) else ():
        chosen = some[parts.short[some] == own]
        if len(chosen):
            windows = passage_matrix(ids, table, length)
            size = np.linalg.norm(windows, axis=1) + 1e-6
            window, part = np.nonzero(windows @ parts.latent[chosen].T >= COSINE * size[:, None])
            near = chosen[part]
            out += zip((window * STEP).tolist(), parts.item[near].tolist(), parts.offset[near].tolist())
    return out


def leaks(coded: DataFrame, items: Items, table: np.ndarray) -> DataFrame:
    """``doc_id, key, item, shared, start``: items found in a document, with the share of words in common."""
    parts = Parts.of(items.lists, table)

    def work(stream):
        items.prepare()
        for batch in batches(stream):
            rows = []
            for doc_id, key, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "ids"))):
                ids = np.frombuffer(x, "<i4")
                best: dict[int, tuple[float, int]] = {}
                tried = set()
                for start, j, offset in candidates(ids, table, parts):
                    at = max(0, start - offset)
                    if (j, at) in tried or best.get(j, (0.0, 0))[0] == 1:
                        continue
                    tried.add((j, at))
                    share = checked(items, j, ids, at)
                    if share and share > best.get(j, (0.0, 0))[0]:
                        best[j] = (share, at)
                rows += [{"doc_id": doc_id, "key": key, "item": j, "shared": s, "start": at} for j, (s, at) in best.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field("doc_id"), ("key", pa.int64()), ("item", pa.int32()), ("shared", pa.float64()), ("start", pa.int32())]))

    id_type = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(work, f"doc_id {id_type}, key long, item int, shared double, start int")


def checked(items: Items, j: int, ids: np.ndarray, start: int) -> float:
    """The share of the item's words found in order around the window; 0 if that's no leak."""
    n = len(items.lists[j])
    around = ids[max(0, start - n // 2) : start + STEP * STEPS + n].tolist()
    found = list(filter(None, map(items.masks[j].get, around)))
    if min(len(found), reduce(or_, found, 0).bit_count()) / n < MAYBE:  # no common subsequence is longer
        return 0.0
    share = matched(found, n) / n
    if n < 5:
        return share if share == 1 else 0.0
    if share >= SURE:
        return share
    if share >= MAYBE:
        end = answer(items.lists[j])
        if common_subsequence(items.answers[j], len(end), around) >= ANSWER * len(end):
            return share
    return 0.0


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, key, item_id, shared, start``: a row for each item found in a row of ``docs``."""
    spark = docs.sparkSession
    rows = keyed(docs)
    items_table = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items_table.agg(F.count("*").alias("items"), F.sum(F.regexp_count("text", F.lit(r"(?U)\w+"))).alias("words")).first()
    slices = max(1, -(-size["items"] // SLICE), -(-(size["words"] or 0) // SLICE_WORDS))
    id_field = benchmark.schema["item_id"]
    out = None
    for k in range(slices):
        part = items_table if slices == 1 else items_table.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        items = read_items(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=repr))
        if not items.lists:
            continue
        path = scratch_path(spark, "word-numbers")
        word_numbers(rows, items).write.parquet(path)
        coded = spark.read.parquet(path)
        frequency, n = document_frequency(coded, len(items.words))
        idf = weights(frequency, n)
        table = latent_space(coded, items, idf)
        found = leaks(coded, items, table)
        names = spark.createDataFrame([(j, i) for j, i in enumerate(items.ids)], f"item int, item_id {id_field.dataType.simpleString()}")
        named = found.join(F.broadcast(names), "item").select("doc_id", "key", "item_id", "shared", "start")  # SLICE names at most
        out = named if out is None else out.unionByName(named)
    if out is None:
        empty = rows.select("doc_id", "key").where("false")
        return empty.select("doc_id", "key", F.lit(None).cast(id_field.dataType).alias("item_id"), F.lit(0.0).alias("shared"), F.lit(0).alias("start"))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    key = free_name(docs, "key")
    found = find_leaks(docs, benchmark).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, doc_key(docs)).join(found, key, "left_anti").drop(key)
