"""BPE encoding and decoding with a lexicon of frequent words.

The corpus' most frequent words are compiled into a minimal acyclic transducer: a
deterministic automaton in which equal suffixes share their states. Numbers on the
edges add up to the word's place in a table of token ids. The arrays of the automaton
form one file that every executor fetches once and its workers map into memory. Words
that the automaton doesn't know are merged pair by pair, so ids are always exact.

Defined cases: null and empty texts give no ids and decode to the empty text; a null
list of ids decodes to the empty text; repeated rows give repeated results; an empty
table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from evenkeel.llm import bpe
from evenkeel.llm.common import add_columns, batches, texts_of
from evenkeel.session import cut_lineage, scratch_path

MAX_WORDS = 32768  # words in the lexicon at most
COUNTED_AT_ONCE = 400_000  # different words that a task counts before it hands them on
KEPT_WORDS = 300_000  # different words whose ids a worker keeps
TEXTS = 512  # texts encoded at once
SLICES = 65536  # words whose ids are put together at once


def compile_words(words: dict[str, list[int]]) -> bytes:
    """The words' minimal acyclic transducer as one block of bytes.

    Words go in in sorted order; a finished suffix is replaced by an equal one that is
    already there. Each state knows how many words lie below it, so the edges' numbers
    give every word its place in sorted order.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []
    path: list[list] = [[False, []]]  # open states: final, [(letter, target)]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            state = (final, tuple(edges))
            number = known.get(state)
            if number is None:
                number = known[state] = len(states)
                states.append(state)
                below.append(final + sum(below[t] for _, t in edges))
            path[-1][1][-1] = (path[-1][1][-1][0], number)

    last = ""
    for word in sorted(words):
        shared = len(os.path.commonprefix((word, last)))
        close(shared)
        for letter in word[shared:]:
            path[-1][1].append((ord(letter), -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    first, final, label, target, skip = [0], [], [], [], []
    for is_final, edges in states:
        passed = int(is_final)
        for letter, to in edges:
            label.append(letter)
            target.append(to)
            skip.append(passed)
            passed += below[to]
        final.append(int(is_final))
        first.append(len(label))
    lists = [words[w] for w in sorted(words)]
    starts = np.cumsum([0, *map(len, lists)])
    parts = [np.asarray(x, dtype="<i4") for x in (first, final, label, target, skip, starts, [i for ids in lists for i in ids])]
    return np.asarray([len(p) for p in parts], dtype="<i4").tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype="<i4", mode="r")
        cuts = 7 + np.cumsum([0, *data[:7]])
        self.first, self.final, self.label, self.target, self.skip, self.starts, self.ids = (memoryview(data[a:b]) for a, b in zip(cuts, cuts[1:]))
        self.root = len(self.final) - 1
        self.edges = np.repeat(np.arange(len(self.final)), np.diff(self.first)) << 21 | np.asarray(self.label, dtype=np.int64)  # rising

    def place(self, word: str) -> int:
        """The word's place in the table of ids, or -1 if it isn't in the lexicon."""
        state, place = self.root, 0
        for letter in map(ord, word):
            end = self.first[state + 1]
            edge = bisect_left(self.label, letter, self.first[state], end)
            if edge == end or self.label[edge] != letter:
                return -1
            place += self.skip[edge]
            state = self.target[edge]
        return place if self.final[state] else -1

    def lookup(self, word: str) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        place = self.place(word)
        return None if place < 0 else list(self.ids[self.starts[place] : self.starts[place + 1]])


    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word: words take their steps side by side, long ones alone."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        first, final, target, skip = (np.asarray(x) for x in (self.first, self.final, self.target, self.skip))
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.edges):
            return out
        for k in np.flatnonzero(sizes > bpe.SHORT).tolist():
            out[k] = self.place(words[k])
        going, end = np.flatnonzero(sizes <= bpe.SHORT), np.cumsum(sizes)
        at, end = (end - sizes)[going], end[going]
        state, place = np.full(len(going), self.root), np.zeros(len(going), dtype=np.int64)
        while len(going):
            there = at == end
            if there.any():
                ended = there & (final[state] > 0)
                out[going[ended]] = place[ended]
                going, at, state, place, end = (x[~there] for x in (going, at, state, place, end))
            key = state << 21 | letters[at]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[edge] == key
            edge = edge[found]
            going, at, end = going[found], at[found] + 1, end[found]
            state, place = target[edge].astype(np.int64), place[found] + skip[edge]
        return out


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of every start and size, one after the other."""
    ends = np.append(0, np.cumsum(sizes))
    out = np.empty(ends[-1], dtype=values.dtype)
    for a in range(0, len(starts), SLICES):
        some, n = slice(a, a + SLICES), sizes[a : a + SLICES]
        first, last = ends[a], ends[a + len(n)]
        out[first:last] = values[np.repeat(starts[some] - ends[:-1][some], n) + np.arange(first, last)]
    return out


class Words:
    """Ids of white-space separated words, each looked up or merged once."""

    def __init__(self, tokenizer: bpe.WordBpe, lexicon: Lexicon | None):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.forget()

    def forget(self) -> None:
        special = self.tokenizer.special.values()
        self.known: dict[str | int, int] = {i: k for k, i in enumerate(special)}  # special tokens stand for themselves
        self.ids = np.fromiter(special, dtype=np.int32, count=len(special))
        self.starts, self.sizes = np.arange(len(special)), np.ones(len(special), dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids.astype(np.int32))

    def learn(self, words: set[str | int]) -> None:
        """Looks new words up in the lexicon and merges the rest side by side."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        new = list(words - self.known.keys())
        if new and self.lexicon:
            places = self.lexicon.places(new)
            starts = np.asarray(self.lexicon.starts, dtype=np.int64)
            found = places[places >= 0]
            sizes = starts[found + 1] - starts[found]
            self.add([new[k] for k in np.flatnonzero(places >= 0).tolist()], slices(np.asarray(self.lexicon.ids), starts[found], sizes), sizes)
            new = [new[k] for k in np.flatnonzero(places < 0).tolist()]
        if not new:
            return
        new, pieces, n = self.tokenizer.pieces_of(new)
        number: dict[str, int] = {}
        which = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
        ids, starts, sizes = self.tokenizer.merge(list(number))
        up_to = np.append(0, np.cumsum(sizes[which]))[np.append(0, np.cumsum(n))]
        self.add(new, slices(ids, starts[which], sizes[which]), np.diff(up_to))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end, from 0."""
        tokenizer, parts = self.tokenizer, []
        for text in texts:
            segments = tokenizer.segments(text)
            words = tokenizer.chunks(segments[0])
            for i, part in enumerate(segments[1:]):
                words += tokenizer.chunks(part) if i % 2 else [tokenizer.special[part]]
            parts.append(words)
        self.learn(set().union(*parts))
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(counts.sum()))
        sizes = self.sizes[number]
        return slices(self.ids, self.starts[number], sizes), np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids, four bytes each."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """``word, n`` of the corpus' normalised words; tasks add up before the shuffle."""

    def count(stream):
        tokenizer = bpe.load(path)

        def hand_on(words):
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        words = Counter()
        for batch in batches(stream):
            for text in texts_of(batch):
                for part in tokenizer.segments(text)[::2]:
                    words.update(tokenizer.chunks(part))
            if len(words) > COUNTED_AT_ONCE:
                yield hand_on(words)
                words.clear()
        yield hand_on(words)

    parts = docs.select("text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """``word`` of those above the lowest count that leaves at most ``most`` of them.

    A small histogram finds that count, so ties stay together.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    total, lowest = 0, 1 << 30
    for row in sorted(rows, reverse=True):
        total += row["words"]
        if total > most:
            break
        lowest = row["step"]
    return counts.where(step >= lowest).select("word")


def build_lexicon(docs: DataFrame, path: str, most: int = MAX_WORDS) -> str:
    """Counts words, compiles the frequent ones and hands the file to all executors; its name.

    One task compiles them, ``most`` at the most, and only the finished automaton comes
    to the driver.
    """
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs, path).where("n > 1"))

    def build(stream):
        tokenizer = bpe.load(path)
        words = [w for batch in stream for w in batch.column("word").to_pylist()]
        ids = Words(tokenizer, None)
        ids.learn(set(words))
        data = compile_words({w: ids.ids[ids.starts[k] : ids.starts[k] + ids.sizes[k]].tolist() for w, k in zip(words, map(ids.known.__getitem__, words))})
        yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

    data = frequent_words(counts, most).repartition(1).mapInArrow(build, "data binary").first()
    return shared_file(spark, data["data"] if data else compile_words({}))


def shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes a file below the shared folder and hands it to all executors; its name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "lexicon") + ".bin")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return path.getName()


def joined_tokens(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Decoding as the library does for a vocabulary without a decoder; a null list gives the empty text."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(ids.flatten())), " ")


def encode(docs: DataFrame, path: str, lexicon: str | None = None, decoded: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``ids array<int>``: its tokens, no special ones added.

    ``path`` is the vocabulary file on every executor, ``lexicon`` a name from
    :func:`build_lexicon` (built from ``docs`` if not given). With ``decoded`` the ids are
    decoded again on the spot, so that one worker and one pass do both.
    """
    lexicon = lexicon or build_lexicon(docs, path)

    def make():
        tokenizer = bpe.load(path)
        words, tokens = Words(tokenizer, mapped(lexicon)), pa.array(tokenizer.tokens, pa.string())

        def call(texts):
            ids, ends = words.encode_flat(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            return [lists, joined_tokens(tokens, lists)] if decoded else [lists]

        return call

    added = [("ids", ArrayType(IntegerType())), ("decoded", StringType())]
    return add_columns(docs, added if decoded else added[:1], make, rows=TEXTS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Every row with ``decoded string``: the tokens of ``ids``, special ones included."""

    def work(stream):
        tokens = pa.array(bpe.load(path).tokens, pa.string())
        for batch in batches(stream):
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_tokens(tokens, batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    if "decoded" in encoded.columns:
        raise ValueError("the table already has a column named decoded")
    return encoded.mapInArrow(work, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row."""
    both = encode(docs.select("doc_id", "text"), path, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "ids",
    )
