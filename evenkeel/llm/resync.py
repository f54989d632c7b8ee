"""Token counts; huge documents are counted in overlapping chunks that are spliced.

Short texts are counted where they lie. A long one is cut into overlapping chunks that
are dealt to all tasks and encoded with offsets. The splitting pattern reads from left
to right and never looks back, so if two neighbouring chunks both start a new word at
the same place, away from the end of the left one, they agree on all that follows: the
left chunk counts up to that place, the right one from it. Documents with an overlap
without such a place are cut again with chunks and overlaps twice as large.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows give
repeated results; an empty table gives no rows; special strings inside a text are
special tokens, as in the library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm.common import batches, keyed, texts_of
from evenkeel.session import cut_lineage

CHUNK = 32768  # characters
OVERLAP = 1024
MARGIN = 16  # characters before a chunk's end that may still change a boundary; the longest special token has 13
KEPT_WORDS = 300_000  # words whose counts a worker keeps
BETWEEN = re.compile(r"(?<=\S) (?=\S)")  # a blank there always begins a new word, whatever stands around it


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    return Tokenizer.from_file(path)


class Counter:
    """Tokens of texts as the sum over words that can't influence each other."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split = [BETWEEN.split(t) for t in texts]
        for parts in split:
            parts[1:] = [" " + p for p in parts[1:]]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys())
        for word, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[word] = len(encoded)
        known = self.known
        return [sum([known[p] for p in parts]) for parts in split]


def boundaries(tokenizer: Tokenizer, text: str) -> tuple[list[int], list[int], int]:
    """Places where a word begins, the number of tokens before each, and of all tokens."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    at, before, last = [], [], None
    for i, (word, (start, _)) in enumerate(zip(encoded.word_ids, encoded.offsets)):
        if word != last:
            at.append(start)
            before.append(i)
            last = word
    return at, before, len(encoded.ids)


def cut(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``key, part, parts, start, piece``: overlapping chunks of every text."""
    stride = chunk - overlap

    def work(stream):
        for batch in batches(stream, 64):
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch)):
                parts = max(1, -(-(len(text) - overlap) // stride))
                for first in range(0, parts, 64):
                    some = range(first, min(parts, first + 64))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array([key] * len(some), pa.int64()),
                            "part": pa.array(list(some), pa.int32()),
                            "parts": pa.array([parts] * len(some), pa.int32()),
                            "start": pa.array([k * stride for k in some], pa.int64()),
                            "piece": pa.array([text[k * stride : k * stride + chunk] for k in some], pa.string()),
                        }
                    )

    return long_docs.select("key", "text").mapInArrow(work, "key long, part int, parts int, start long, piece string")


ENCODED = "key long, part int, parts int, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def encode_parts(pieces: DataFrame, path: str, overlap: int) -> DataFrame:
    """Token count of each chunk and its word boundaries in both overlaps."""

    def work(stream):
        tokenizer = load(path)
        for batch in batches(stream, 64):
            rows = []
            for row in batch.to_pylist():
                at, before, n = boundaries(tokenizer, row["piece"])
                start, size = row["start"], len(row["piece"])
                left = [i for i, x in enumerate(at) if x < overlap] if row["part"] else []
                right = [i for i, x in enumerate(at) if size - overlap <= x <= size - MARGIN] if row["part"] + 1 < row["parts"] else []
                rows.append(
                    {"key": row["key"], "part": row["part"], "parts": row["parts"], "n": n}
                    | {"left_at": [start + at[i] for i in left], "left_n": [before[i] for i in left]}
                    | {"right_at": [start + at[i] for i in right], "right_n": [before[i] for i in right]}
                )
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    longs = pa.list_(pa.int64())
    SCHEMA = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("n", pa.int64())] + [(c, longs) for c in ("left_at", "left_n", "right_at", "right_n")])
    return pieces.repartition("key", "part").mapInArrow(work, ENCODED)


def splice(parts: DataFrame) -> DataFrame:
    """``key, n_tokens``; null where two neighbours share no boundary."""
    left = parts.where("part + 1 < parts").select("key", "part", F.col("n").alias("all_left"), "right_at", "right_n")
    right = parts.where("part > 0").select("key", (F.col("part") - 1).alias("part"), "left_at", "left_n")
    place = F.array_min(F.array_intersect("right_at", "left_at"))
    twice = (
        left.join(right, ["key", "part"])
        .withColumn("place", place)
        .select("key", F.lit(0).alias("n"), F.col("place").isNotNull().cast("int").alias("joined"), F.lit(0).alias("parts"),
                (F.col("all_left") - F.expr("right_n[array_position(right_at, place) - 1]") + F.expr("left_n[array_position(left_at, place) - 1]")).alias("twice"))
    )
    own = parts.select("key", "n", F.lit(0).alias("joined"), F.lit(1).alias("parts"), F.lit(0).alias("twice"))
    sums = own.unionByName(twice).groupBy("key").agg(F.sum("n").alias("n"), F.sum("joined").alias("joined"), F.sum("parts").alias("parts"), F.sum("twice").alias("twice"))
    return sums.select("key", F.when(F.col("joined") == F.col("parts") - 1, F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def long_counts(long_docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of long documents, each key once."""
    left, done = long_docs.select("key", "text").dropDuplicates(["key"]), None
    while True:
        parts = cut_lineage(encode_parts(cut(left, chunk, overlap), path, overlap))
        found = cut_lineage(splice(parts))
        good = found.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = found.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return done
        left = left.join(failed, "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``.

    ``chunk`` must be more than twice ``overlap``, so that the overlaps of a chunk don't meet.
    """
    if chunk <= 2 * overlap or overlap <= MARGIN:
        raise ValueError("a chunk must be longer than two overlaps, an overlap longer than the margin")
    rows = keyed(docs)
    is_long = F.length("text") > chunk

    def work(stream):
        counter = Counter(path)
        for batch in batches(stream):
            counts = pa.array(counter.count(texts_of(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = sized.where(~is_long).select("doc_id", "n_bytes", "text").mapInArrow(work, f"doc_id {id_type}, n_bytes long, n_tokens long")
    long_rows = sized.where(is_long)
    counts = long_counts(long_rows, path, chunk, overlap)
    return short.unionByName(long_rows.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
