"""Ranked lexical search with pair-bound MaxScore.

``build_index`` cuts the documents into segments and writes, for every segment and term,
the places of its documents and the term's counts. For a block of items ``lists`` turns
these into impact lists, one for each term, and into intersection lists for pairs of
terms that stand together in an item; every list stores its largest (joint) impact.

A segment is searched as in MaxScore: terms whose bounds together stay below the
threshold are not essential, only documents of essential lists are scored, and those are
given up as soon as what is left can't lift them to the threshold. The bound of several
terms is not the sum of their largest impacts: pairs are matched greedily, and a matched
pair counts with ``max(peak a, peak b, joint peak)``, for no document holds both at their
best unless the intersection list says so. Whole segments are skipped by that bound. The
threshold is the k-th best score known from impact and intersection lists of all
segments, so it holds for the whole corpus before the first document is scored.

Documents are split by segment and never by term: a frequent term has a short list in
each segment, and a task never sees more than one segment.

Weights and scores are 64-bit integers (see ``weight`` and ``saturated``).

Defined cases: a null text has no term; documents without a term are not counted and
never found; items without a known term give no rows; rows of the documents that agree in
everything are ranked one after the other; a null ``doc_id`` comes after the others of
its score; items that agree in id and text are one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evenkeel.llm.common import batches, text_col
from evenkeel.session import scratch_path

SEGMENT_DOCS, SEGMENT_TERMS = 4096, 2_000_000  # of a segment, at most 65536 documents; a longer document is a segment of its own
BLOCK_TERMS = 400_000  # terms of the items that are searched together; they are broadcast and travel with the tasks
REACH = 2  # each term of an item is paired with so many that follow in the order of weight
TOP = 50
#: ASCII letters and digits; everything else below 128 separates, A to Z become small.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of the score before its weight."""
    m = 50 + (50 * lengths * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of each stretch of an array."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def counts_of(held: bytes, n: int) -> np.ndarray:
    """Counts of ``n`` documents; a segment writes them in two bytes each, or four if one needs it."""
    return np.frombuffer(held, np.uint16 if len(held) == 2 * n else np.uint32).astype(np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """``segment, term, df, total, places, counts, ids``, written to the shared folder.

    ``places`` are the term's documents, as numbers of two bytes, ``counts`` how often
    each has it. A row with a null term lists a segment's documents: ``counts`` has
    their lengths, ``total`` the sum of them.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_ids = pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))

    def numbers() -> defaultdict:
        number: dict[bytes, int] = defaultdict(int)
        number.default_factory = number.__len__
        return number

    def segments(stream) -> Iterator[tuple[list, list[np.ndarray], dict[bytes, int]]]:
        ids, held, size, number = [], [], 0, numbers()
        for batch in batches(stream):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                if held and (len(held) >= SEGMENT_DOCS or size + len(terms) > SEGMENT_TERMS):
                    yield ids, held, number
                    ids, held, size, number = [], [], 0, numbers()
                ids.append(doc_id)
                held.append(np.fromiter((number[t] for t in terms), np.uint32, len(terms)))
                size += len(terms)
        if held:
            yield ids, held, number

    def work(stream):
        for ids, held, number in segments(stream):
            lengths = np.array([len(t) for t in held], dtype=np.int64)
            pairs, counts = np.unique(np.concatenate(held).astype(np.int64) << 32 | np.repeat(np.arange(len(held)), lengths), return_counts=True)
            n = len(number)
            ends = np.append(np.searchsorted(pairs >> 32, np.arange(n + 1)), [len(pairs)])
            df = np.append(np.diff(ends)[:-1], len(held))
            every = np.concatenate([counts, lengths])
            every = every.astype(np.uint16 if every.max() < 1 << 16 else np.uint32)
            ends_counts = np.append(ends[:-1], len(every))
            arrays = [
                pa.array(np.full(n + 1, uuid4().int >> 65)),
                pa.concat_arrays([pa.array(list(number), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
                pa.array(df.astype(np.int32)),
                pa.array(np.append(np.zeros(n, np.int64), lengths.sum())),
                slices((pairs & 0xFFFFFFFF).astype(np.uint16), ends),
                slices(every, ends_counts),
                pa.array([None] * n + [ids], arrow_ids),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["segment", "term", "df", "total", "places", "counts", "ids"])

    path = scratch_path(docs.sparkSession, "index")
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_col(docs).alias("text"))
    rows.mapInArrow(work, f"segment long, term string, df int, total long, places binary, counts binary, ids array<{id_type}>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Block:
    """Items searched together: numbers of their terms, heaviest first, and the terms' weights."""

    ids: list
    terms: list[list[int]]
    weights: np.ndarray
    words: list[str]

    def pairs(self) -> dict[tuple[int, int], int]:
        found = sorted({(min(a, b), max(a, b)) for ts in self.terms for i, a in enumerate(ts) for b in ts[i + 1 : i + 1 + REACH]})
        return {p: n for n, p in enumerate(found)}


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    row = index.where("term IS NULL").agg(F.sum("df"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows ``item_id, text`` in blocks of bounded total length; equal rows come once."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = F.length("text") / 2 + 1  # a term and what parts it from the next are two characters at least
    total, most = rows.agg(F.sum(size), F.max(size)).first()
    blocks = math.ceil(2 * (total or 0) / max(BLOCK_TERMS, most or 0))
    for b in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()


def block_of(index: DataFrame, rows: list, n_docs: int) -> Block:
    """The block's terms with their weights; document frequencies are sums over the segments."""
    spark = index.sparkSession
    of_item = [sorted(set(terms_of(r["text"]))) for r in rows]
    words = [w.decode() for w in sorted(set().union(*of_item))]
    asked = spark.createDataFrame([(w,) for w in words], "term string")
    df = {r["term"]: r["df"] for r in index.select("term", "df").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    words = [w for w in words if w in df]
    number = {w.encode(): k for k, w in enumerate(words)}
    weights = np.array([weight(n_docs, df[w]) for w in words], dtype=np.int64)
    terms = [sorted((number[t] for t in ts if t in number), key=lambda k: (-weights[k], k)) for ts in of_item]
    return Block([r["item_id"] for r in rows], terms, weights, words)


def lists(index: DataFrame, block: Block, n_docs: int, n_terms: int) -> DataFrame:
    """``segment, a, b, peak, places, impacts, ids``: impact lists (b = -1), intersection lists, documents (a = -1).

    Impact lists hold the terms' shares (four bytes), to be multiplied by the terms'
    weights, intersection lists the joint impacts (eight bytes). Rows with ``b = -2`` hold, for item ``a``, the best scores that the segment's lists prove.
    """
    spark = index.sparkSession
    terms = spark.createDataFrame(list(zip(block.words, range(len(block.words)))), "term string, a int")
    known = index.where("term IS NOT NULL").join(F.broadcast(terms), "term").select("segment", "a", "df", "places", "counts", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))
    rows = known.unionByName(index.where("term IS NULL").select("segment", F.lit(-1).alias("a"), "df", "places", "counts", "ids"))
    pairs = block.pairs()
    id_list = index.schema["ids"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        a = table.column("a").to_numpy()
        df, places, counts = (table.column(c).to_pylist() for c in ("df", "places", "counts"))
        at = int(np.flatnonzero(a == -1)[0])
        lengths = counts_of(counts[at], df[at])
        nothing = np.empty(0, np.uint16)
        out: list[tuple[int, int, int, np.ndarray, np.ndarray]] = [(-1, -1, 0, nothing, nothing)]
        single: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, term in enumerate(a.tolist()):
            if term >= 0:
                where = np.frombuffer(places[k], np.uint16)
                share = saturated(counts_of(counts[k], df[k]), lengths[where], n_docs, n_terms)
                single[term] = where, block.weights[term] * share
                out.append((term, -1, int(single[term][1].max()), where, share.astype(np.uint32)))
        joint: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        dense, last = np.zeros(len(lengths), dtype=np.int64), -1
        for x, y in pairs:  # sorted by x
            if x not in single or y not in single:
                continue
            if x != last:
                if last >= 0:
                    dense[single[last][0]] = 0
                last = x
                dense[single[x][0]] = single[x][1] + 1  # an impact may be 0
            where, impact = single[y]
            both = dense[where] > 0
            if both.any():
                joint[x, y] = where[both], impact[both] + dense[where[both]] - 1
                out.append((x, y, int(joint[x, y][1].max()), *joint[x, y]))
        for item, own in enumerate(block.terms):
            proven = np.zeros(len(lengths), dtype=np.int64)
            own = [t for t in own if t in single]
            for i, t in enumerate(own):
                for where, impact in [single[t], *(joint[p] for u in own[i + 1 : i + 1 + REACH] if (p := (min(t, u), max(t, u))) in joint)]:
                    proven[where] = np.maximum(proven[where], impact)
            best = np.sort(proven[proven > 0])[::-1][:TOP]
            if len(best):
                out.append((item, -2, 0, nothing, best))
        ids = table.column("ids")[at].as_py()
        return pa.table(
            {
                "segment": pa.array(np.full(len(out), table.column("segment")[0].as_py())),
                "a": pa.array([o[0] for o in out], pa.int32()),
                "b": pa.array([o[1] for o in out], pa.int32()),
                "peak": pa.array([o[2] for o in out], pa.int64()),
                "places": pa.array([o[3].tobytes() for o in out], pa.binary()),
                "impacts": pa.array([o[4].tobytes() for o in out], pa.binary()),
                "ids": pa.array([ids] + [None] * (len(out) - 1), table.schema.field("ids").type),
            }
        )

    path = scratch_path(spark, "lists")
    made = rows.groupBy("segment").applyInArrow(build, f"segment long, a int, b int, peak long, places binary, impacts binary, ids {id_list}")
    made.write.parquet(path)
    return spark.read.parquet(path)


def thresholds(made: DataFrame, items: int, top: int) -> np.ndarray:
    """For each item of the block a score that ``top`` documents are known to reach; 0 where there are fewer."""

    def scores(stream):
        for batch in stream:
            for item, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(held, dtype=np.int64)[:top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), item, dtype=np.int32)), pa.array(values)], names=["item", "score"])

    proven = made.where("b = -2").select("a", "impacts").mapInArrow(scores, "item int, score long")
    ranked = proven.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).where(F.col("rank") <= top)
    out = np.zeros(items, dtype=np.int64)
    for r in ranked.where(F.col("rank") == top).select("item", "score").collect():  # one row for each item
        out[r["item"]] = r["score"]
    return out


def matched(own: list[int], peaks: dict[int, int], joints: dict[tuple[int, int], int], pairs) -> dict[int, tuple[int, int]]:
    """Partner and saving of each matched term; pairs that save most come first."""
    savings = []
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            p = (min(a, b), max(a, b))
            if p in pairs:
                saving = peaks[a] + peaks[b] - max(peaks[a], peaks[b], joints.get(p, 0))
                if saving > 0:
                    savings.append((saving, p))
    out: dict[int, tuple[int, int]] = {}
    for saving, (a, b) in sorted(savings, reverse=True):
        if a not in out and b not in out:
            out[a], out[b] = (b, saving), (a, saving)
    return out


def search_segment(own: list[int], single: dict, peaks: dict, joints: dict, pairs, n: int, floor: int, top: int, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a segment's documents that may be among the ``top``: none below ``floor`` is needed."""
    own = sorted((t for t in own if t in single), key=lambda t: peaks[t])
    partner = matched(own, peaks, joints, pairs)
    bounds, seen, total = [0], set(), 0  # bounds[j]: of the first j terms
    for t in own:
        total += peaks[t]
        seen.add(t)
        if t in partner and partner[t][0] in seen:
            total -= partner[t][1]
        bounds.append(total)
    floor = max(floor, 1)
    free = next((j for j in range(len(own), -1, -1) if bounds[j] < floor), 0)
    if free == len(own):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    score = np.zeros(n, dtype=np.int64)
    for t in own[free:]:
        score[single[t][0]] += single[t][1]
    there = np.flatnonzero(score)
    if counted is not None:
        counted["scored"] = counted.get("scored", 0) + len(there)
    for j in range(free, -1, -1):
        now = score[there]
        if len(now) > top:
            floor = max(floor, int(np.partition(now, len(now) - top)[len(now) - top]))
        there = there[now + bounds[j] >= floor]
        if j and len(there):
            where, impact = single[own[j - 1]]
            at = np.minimum(np.searchsorted(where, there), len(where) - 1)
            score[there] += np.where(where[at] == there, impact[at], 0)
    return there, score[there]


def found_in(made: DataFrame, block: Block, floors: np.ndarray, top: int) -> DataFrame:
    """``item, doc_id, score``: each segment's best documents of each item."""
    pairs = block.pairs()
    id_type = made.schema["ids"].dataType.elementType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        a, b, peak = (table.column(c).to_numpy() for c in ("a", "b", "peak"))
        places, impacts = table.column("places"), table.column("impacts")
        ids = table.column("ids")[int(np.flatnonzero(a == -1)[0])].as_py()
        single, peaks, joints = {}, {}, {}
        for k, (x, y, p) in enumerate(zip(a.tolist(), b.tolist(), peak.tolist())):
            if x < 0:
                continue
            if y >= 0:
                joints[x, y] = p
            else:
                single[x] = np.frombuffer(places[k].as_py(), np.uint16).astype(np.int64), block.weights[x] * np.frombuffer(impacts[k].as_py(), np.uint32).astype(np.int64)
                peaks[x] = p
        out = []
        for item, own in enumerate(block.terms):
            there, score = search_segment(own, single, peaks, joints, pairs, len(ids), int(floors[item]), top)
            rows = sorted(((-s, ids[p] is None, ids[p]) for p, s in zip(there.tolist(), score.tolist()) if s > 0), key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
            out += [(item, doc_id, -s) for s, _, doc_id in rows[:top]]
        types = [pa.int32(), table.schema.field("ids").type.value_type, pa.int64()]
        return pa.table({c: pa.array([o[k] for o in out], types[k]) for k, c in enumerate(("item", "doc_id", "score"))})

    # of a pair only the largest joint impact is needed here
    slim = [F.when(F.col("b") == -1, F.col(c)).alias(c) for c in ("places", "impacts")]
    return made.where("b <> -2").select("segment", "a", "b", "peak", *slim, "ids").groupBy("segment").applyInArrow(search, f"item int, doc_id {id_type}, score long")


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` (at most TOP) documents of each item, best first."""
    if not 0 < top <= TOP:
        raise ValueError(f"top must be from 1 to {TOP}")
    spark: SparkSession = index.sparkSession
    n_docs, n_terms = corpus_size(index)
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    done = []
    for rows in item_blocks(items) if n_docs else ():
        block = block_of(index, rows, n_docs)
        if not block.words:
            continue
        made = lists(index, block, n_docs, n_terms)
        found = found_in(made, block, thresholds(made, len(block.ids), top), top)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_type}")
        path = scratch_path(spark, "ranked")
        ranked.join(names, "item").select("item_id", "rank", "doc_id", "score").write.parquet(path)
        done.append(path)
    if not done:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    return spark.read.parquet(*done)
