"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a word n-gram's hash is the minimum of its window, so the
places depend on the content alone: two equal passages of LENGTH words keep at least one
suffix at the same place within them. Suffixes whose n-gram occurs once are dropped. Those
whose n-gram occurs up to FEW times are dealt out and sorted by it and by what follows;
all of an n-gram are compared with each other, the matches extended to the right and to
the left, and kept if they have LENGTH words. An n-gram that occurs more often may lie in
frequent text, where no order has all equal passages side by side: there each window of
LENGTH words whose minimum it is goes by its 128-bit hash, and hashes that occur again are
matches. So every window that occurs twice is found, whatever else shares its n-gram.
Overlapping matches of a document are joined to maximal passages.

A suffix carries REACH words to each side as 24-bit hashes; longer passages have several
kept suffixes, whose matches join. Texts whose words are all equal are sorted once and
stand for each other.

Defined cases: words are separated by white space and compared as they are; null, empty
and short texts have no passages; a passage repeated within one document counts; rows
equal in ``doc_id`` and text are one document; equal texts of LENGTH words or more are
passages as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import batches, keyed, texts_of
from evenkeel.session import cut_lineage, scratch_path

LENGTH = 50  # words of the shortest passage
GRAM = 8  # words of the n-gram that selects a suffix
FEW = 8  # suffixes of an n-gram that are all compared with each other
REACH = 50  # words carried to each side
BYTES = 3  # of a word's hash in what is carried
KNOWN_WORDS = 300_000
SUFFIX = "gram long, right binary, left binary, key long, pos int, window binary"


class Words:
    """64-bit hashes of a text's words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    out = words[:n].copy()
    for k in range(1, size if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def minima(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window the place of its minimum, the rightmost of equals."""
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    return (len(grams) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))[::-1]


def selected(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that are the rightmost minimum of some window; of a shorter text the minimum of all."""
    if not len(grams):
        return np.empty(0, np.int64)
    return np.unique(minima(grams, min(window, len(grams))))


def three_bytes(words: np.ndarray) -> bytes:
    return (words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def selected_places(rows: DataFrame, length: int) -> DataFrame:
    """``doc_id, key, n_words, body, pos, gram``: 128 bits over all words of each text of enough words, and its kept places."""
    window = length - GRAM + 1

    def work(stream):
        words = Words()
        for batch in batches(stream):
            found = [words.of(t) for t in texts_of(batch)]
            long_enough = pa.array([i for i, w in enumerate(found) if len(w) >= length], pa.int64())
            found = [found[i] for i in long_enough.to_pylist()]
            grams = [gram_hashes(w, GRAM) for w in found]
            places = [selected(g, window) for g in grams]
            ends = pa.array(np.cumsum([0, *map(len, places)], dtype=np.int32))
            flat = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int32)
            values = np.concatenate([*(g[p] for g, p in zip(grams, places)), np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(long_enough), batch.column("key").take(long_enough), pa.array([len(w) for w in found], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in found], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(values))],
                names=["doc_id", "key", "n_words", "body", "pos", "gram"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(work, f"doc_id {id_type}, key long, n_words int, body binary, pos array<int>, gram array<long>")


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """``key, text, kept`` to the kept suffixes, with what stands to their right and, backwards, to their left.

    Suffixes marked ``many`` give ``window, key, pos`` instead: hash and place of each
    window of ``length`` words whose minimum they are.
    """

    def work(stream):
        words = Words()
        for batch in batches(stream, 256):
            keys, places, grams, rights, lefts, windows = [], [], [], [], [], []
            for key, text, kept in zip(batch.column("key").to_pylist(), texts_of(batch), batch.column("kept").to_pylist()):
                hashes = words.of(text)
                ahead, behind, n = three_bytes(hashes), three_bytes(hashes[::-1]), len(hashes)
                for one in kept:
                    if one["many"]:
                        continue
                    p = one["pos"]
                    keys.append(key)
                    places.append(p)
                    grams.append(one["gram"])
                    rights.append(ahead[BYTES * p : BYTES * (p + REACH)])
                    lefts.append(behind[BYTES * (n - p) : BYTES * (n - p + REACH)])
                    windows.append(None)
                many = [one["pos"] for one in kept if one["many"]]
                if many:
                    starts = np.flatnonzero(np.isin(minima(gram_hashes(hashes, GRAM), length - GRAM + 1), many)).tolist()
                    body = hashes.tobytes()
                    keys += [key] * len(starts)
                    places += starts
                    windows += [xxhash.xxh3_128_digest(body[8 * at : 8 * (at + length)]) for at in starts]
                    for column in (grams, rights, lefts):
                        column += [None] * len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(windows, pa.binary())],
                names=["gram", "right", "left", "key", "pos", "window"],
            )

    return texts.select("key", "text", "kept").mapInArrow(work, SUFFIX)


def common(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Equal words at the beginning of each pair of rows."""
    same = (a == b).reshape(len(a), REACH, BYTES).all(axis=2)
    until = np.where(same.all(axis=1), REACH, same.argmin(axis=1))
    return np.minimum(until, np.minimum(a_size, b_size))


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(b"".join(p.ljust(REACH * BYTES, b"\0") for p in parts), np.uint8).reshape(len(parts), REACH * BYTES)
    return table, np.array([len(p) // BYTES for p in parts])


def group_matches(rows: list[dict], length: int) -> list[tuple[int, int, int]]:
    """``key, start, end`` for matches between all suffixes of an n-gram, which stand side by side, FEW at most."""
    if len(rows) < 2:
        return []
    right, right_n = padded([r["right"] for r in rows])
    left, left_n = padded([r["left"] for r in rows])
    gram = np.array([r["gram"] for r in rows])
    out = []
    for apart in range(1, min(FEW, len(rows))):
        a = np.flatnonzero(gram[:-apart] == gram[apart:])
        if not len(a):
            break
        b = a + apart
        ahead = common(right[a], right[b], right_n[a], right_n[b])
        behind = common(left[a], left[b], left_n[a], left_n[b])
        far = ahead + behind >= length
        for i, j, x, y in zip(a[far].tolist(), b[far].tolist(), behind[far].tolist(), ahead[far].tolist()):
            out += [(rows[k]["key"], rows[k]["pos"] - x, rows[k]["pos"] + y) for k in (i, j)]
    return list(set(out))


MATCH = pa.schema([("key", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def sorted_matches(kept: DataFrame, length: int) -> DataFrame:
    """``key, begin, end`` of matches between suffixes with the same n-gram; one task has all of an n-gram."""
    ordered = kept.repartition("gram").sortWithinPartitions("gram", "right", "left", "key", "pos")

    def work(stream):
        before = []
        for batch in batches(stream, 4096):
            rows = before + batch.to_pylist()
            found = group_matches(rows, length)
            before = rows[-FEW + 1 :]
            yield pa.RecordBatch.from_pylist([{"key": k, "begin": b, "end": e} for k, b, e in found], schema=MATCH)

    return ordered.mapInArrow(work, "key long, begin int, end int")


def window_matches(windows: DataFrame, length: int) -> DataFrame:
    """``key, begin, end`` of windows whose hash occurs again. Counts are added up before the shuffle."""
    again = cut_lineage(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))  # joined as a table, so that a hot hash is split
    return windows.join(again, "window", "left_semi").select("key", F.col("pos").alias("begin"), (F.col("pos") + length).cast("int").alias("end"))


def joined_spans(matches: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one; within rows, over the document's sorted spans."""
    per_doc = matches.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    start = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.array().cast("array<struct<begin:int,end:int>>").alias("done"))

    def step(state, span):
        apart = span["begin"] > state["end"]
        closed = F.array_append(state["done"], F.struct(state["begin"].alias("begin"), state["end"].alias("end")))
        return F.struct(
            F.when(apart, span["begin"]).otherwise(state["begin"]).alias("begin"),
            F.when(apart, span["end"]).otherwise(F.greatest(state["end"], span["end"])).alias("end"),
            F.when(apart & (state["end"] >= 0), closed).otherwise(state["done"]).alias("done"),
        )

    folded = F.aggregate("spans", start, step, lambda s: F.array_append(s["done"], F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    return per_doc.select("key", F.explode(folded).alias("s")).select("key", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, begin, end``: passages of ``length`` words or more that occur elsewhere too.

    ``begin`` and ``end`` (exclusive) count words from 0; one row for each maximal passage
    of each row of ``docs`` (rows equal in id and text once).
    """
    if length > 2 * REACH:
        raise ValueError(f"passages of more than {2 * REACH} words need a longer reach")
    rows = keyed(docs)
    chosen = cut_lineage(selected_places(rows, length))
    bodies = chosen.select("doc_id", "key", "n_words", "body").dropDuplicates(["key"])
    groups = cut_lineage(bodies.groupBy("body").agg(F.min("key").alias("lead"), F.count("*").alias("copies")))
    leads = groups.select(F.col("lead").alias("key"))
    places = chosen.dropDuplicates(["key"]).join(leads, "key", "left_semi").select("key", F.explode(F.arrays_zip("pos", "gram")).alias("place")).select("key", "place.pos", "place.gram")
    again = cut_lineage(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > FEW).alias("many")))
    kept = places.join(again, "gram").groupBy("key").agg(F.collect_list(F.struct("pos", "gram", "many")).alias("kept"))
    path = scratch_path(docs.sparkSession, "suffixes")
    suffixes(rows.select("key", "text").join(kept, "key"), length).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    few = sorted_matches(found.where("window IS NULL").select("gram", "right", "left", "key", "pos"), length)
    many = window_matches(found.where("window IS NOT NULL").select("window", "key", "pos"), length)
    spans = joined_spans(few.unionByName(many))
    whole = groups.where("copies > 1").select("body")
    of_copies = bodies.join(whole, "body", "left_semi").select("doc_id", F.lit(0).alias("begin"), F.col("n_words").alias("end"))
    single = bodies.join(groups.where("copies = 1").select(F.col("lead").alias("key")), "key", "left_semi").select("doc_id", "key")
    return of_copies.unionByName(single.join(spans, "key").select("doc_id", "begin", "end"))
