"""N-gram Jaccard join by MinHash banding.

Each text's set of word n-grams gets a signature; bands of it are shuffled by their
hash, so that sets of enough similarity meet in some band with the wished recall. Sets
that meet, directly or over others, form a candidate group. Groups are cut into blocks
of bounded size and every pair of blocks is verified on the full n-gram sets by one
task, which returns a count for each set and a spanning forest, never the pairs.

Defined cases: words are lower-cased and separated by white space; a text of fewer
words than n has one n-gram, all its words; texts without a word (null, empty, blank)
have none and are linked to nothing. Rows with equal sets are copies: one of them
stands for all, each counts as a link of the others. A null ``doc_id`` never names a
class unless it has only such rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import batches, doc_key, free_name, keyed, texts_of
from evenkeel.llm.components import connected_components
from evenkeel.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 192
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20  # of a block of a candidate group
KNOWN_WORDS = 300_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands that still find pairs at the threshold with this recall.

    Longer bands let fewer unlike pairs meet. A pair of similarity s shares one of b
    bands of r rows with probability 1 - (1 - s^r)^b.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-min(threshold**rows, 1 - 1e-9)))
        if rows * bands > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes can't reach a recall of {recall} at {threshold}")
    return best


class Shingles:
    """Sorted 64-bit hashes of a text's different word n-grams."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        n = min(self.words, len(h))
        if not n:
            return h
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out)


class Bands:
    """Band hashes of a set of n-grams."""

    def __init__(self, bands: int, rows: int):
        random = np.random.default_rng(20240229)
        self.shape = (bands, rows)
        self.a = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        low = grams.astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(low), 4096):
            least = np.minimum(least, (low[at : at + 4096, None] * self.a + self.b).min(axis=0))
        rows = least.reshape(self.shape).astype(np.uint64)
        out = np.arange(1, self.shape[0] + 1, dtype=np.uint64)
        for k in range(self.shape[1]):
            out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.astype(np.int64)


def signatures(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """``doc_id, key, size, set_hash, bands`` of keyed rows; no hash and no bands without a word."""

    def work(stream):
        shingles, band = Shingles(words), Bands(bands, band_rows)
        for batch in batches(stream):
            grams = [shingles.of(t) for t in texts_of(batch)]
            hashes = [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in grams]
            found = [band.of(g) if len(g) else np.empty(0, np.int64) for g in grams]
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            arrays = [batch.column("doc_id"), batch.column("key"), pa.array([len(g) for g in grams], pa.int32()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], names=["doc_id", "key", "size", "set_hash", "bands"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(work, f"doc_id {id_type}, key long, size int, set_hash binary, bands array<long>")


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets reach the threshold with which others, by exact intersections."""
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(times > 1) - 1  # only n-grams of more than one set count
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    for at in range(0, int(number[-1]) + 1, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        some, place = np.unique(row[lo:hi], return_inverse=True)
        part = np.zeros((len(some), width), dtype=np.float32)
        part[place, column[lo:hi] - at] = 1
        common[np.ix_(some, some)] += part @ part.T
    return common >= np.float32(threshold) * (sizes[:, None] + sizes[None, :] - common) - np.float32(1e-3)


def verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """``key, links, root`` for each set and pair of blocks it takes part in.

    ``links`` counts documents whose set reaches the threshold, ``root`` is the smallest
    set of the pair of blocks that is reached over links.
    """

    def work(table: pa.Table) -> pa.Table:
        rows = {}
        for key, side, copies, text in zip(*(table.column(c).to_pylist() for c in ("key", "side", "copies", "text"))):
            rows[key] = (side, copies, text)
        keys = np.array(sorted(rows), dtype=np.int64)
        shingles = Shingles(words)
        side = np.array([rows[k][0] for k in keys.tolist()])
        copies = np.array([rows[k][1] for k in keys.tolist()], dtype=np.int64)
        links = linked([shingles.of(rows[k][2] or "") for k in keys.tolist()], threshold)
        np.fill_diagonal(links, False)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if not within:
            links &= side[:, None] != side[None, :]
        label = np.arange(len(keys))
        while True:  # keys are sorted, so the smallest number is the smallest key
            least = np.minimum(label, np.where(links, label[None, :], len(keys)).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        return pa.table({"key": keys, "links": (links * copies[None, :]).sum(axis=1), "root": keys[label]})

    return members.groupBy("comp", "i", "j").applyInArrow(work, "key long, links long, root long")


def block_pairs(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``comp, i, j, key, side, copies, text``: each set once for every pair of blocks it is in.

    A group gets as many blocks as keep both the rows and the n-grams of a block bounded.
    """
    totals = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
    dealt = members.join(totals.select("root", blocks.alias("blocks")), "root")
    own = F.pmod(F.hash("key"), F.col("blocks"))
    dealt = dealt.select("key", F.col("root").alias("comp"), "copies", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("key", "comp", "copies", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    return rows.select("key", "text").join(pairs, "key")


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, key, class_id, keeper, n_links``: one row for each row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` reached over links, ``n_links`` the number of
    other rows whose n-gram set has at least the threshold's similarity to this one,
    ``keeper`` the key of the row that stands for the class.
    """
    rows = keyed(docs)
    bands, band_rows = choose_bands(threshold, recall)
    signed = cut_lineage(signatures(rows, words, bands, band_rows))
    has_words = signed.where("set_hash IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key"))
    counted = has_words.groupBy("set_hash").agg(first.alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"))
    sets = cut_lineage(counted.select("set_hash", "copies", "size", "first.doc_id", "first.key"))
    one_each = has_words.join(sets.select("key"), "key", "left_semi").select("key", F.explode("bands").alias("band"))
    buckets = cut_lineage(one_each.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    meets = one_each.join(buckets, "band").where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    groups = connected_components(meets)
    members = block_pairs(rows, groups.join(sets.select("key", "copies", "size"), "key"))
    checked = cut_lineage(verified(members, words, threshold))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = sets.join(classes, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    keeper = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key")).alias("kept"))
    of_set = named.join(keeper, "root").select(
        "set_hash", F.col("kept.doc_id").alias("class_id"), F.col("kept.key").alias("keeper"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked_rows = has_words.select("doc_id", "key", "set_hash").join(of_set, "set_hash").drop("set_hash")
    alone = signed.where("set_hash IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("keeper"), F.lit(0).cast("long").alias("n_links"))
    return linked_rows.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class; of rows equal in id and text one stays."""
    key, place = free_name(docs, "key"), free_name(docs, "place")
    dropped = jaccard_join(docs).where("key <> keeper").select(F.col("key").alias(key)).distinct()
    rest = docs.withColumn(key, doc_key(docs)).join(dropped, key, "left_anti")
    same = Window.partitionBy(key).orderBy(key)
    return rest.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(key, place)
