"""Toxic spans and document scores by a linear-chain conditional random field.

Documents carry the labels, so tokens are labelled first: a token of a toxic training
document counts as toxic if its word or its beginning is far more frequent in toxic
training documents than in the others. The chain has two states; a token's weight is a
sum over hashed features of the word alone, so forward and backward messages are
ratios of two numbers. A document's marginals are summed up and calibrated against the
labels of training documents that the chain was not fitted on.

Bounds: at most DOCS_EACH training documents of each label, those with the smallest
hash of their id, are used for fitting, with WINDOWS_EACH windows of WINDOW tokens of
each; every document is scored over its whole text. Labels, language, source and id are
no inputs of a score.

Defined cases: null and empty texts have no tokens and get the score of a text without
toxic tokens; labels that are null are left out, repeated ones count once (toxic wins);
without labels of both kinds, or without any word that toxic documents have more often,
all scores are 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from evenkeel.llm.common import add_columns, batches, free_name, texts_of
from evenkeel.session import cut_lineage

DOCS_EACH = 3000
WINDOW, WINDOWS_EACH = 48, 6
BUCKETS = 1 << 18  # of the hashed features
ROUNDS, STEP, DECAY = 60, 0.5, 1e-5
SEEDS, SEED_DOCS, SEED_ODDS = 4000, 3, 3.0  # most, documents at least, log odds at least
KNOWN_WORDS = 300_000
WINDOWS_AT_ONCE = 4096
TEXTS = 2048  # texts that go forward and back in step
TOKEN = re.compile(r"\w+")
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", DoubleType())])


def features(word: str) -> list[int]:
    """Places of a word's features among the hashed ones."""
    names = ["w " + word, "e " + word[-3:], f"n {min(len(word), 12)}", *(f"b{n} {word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def signs(word: str) -> list[str]:
    """What may mark a word as toxic: itself or its beginning."""
    return ["w " + word, *(f"b {word[:n]}" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


@dataclass
class Model:
    weight: np.ndarray
    move: np.ndarray  # factors of the four moves between states
    start: float
    calibration: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def emission(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = float(self.weight[features(w)].sum())
        return np.array([known[w] for w in words])

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def marginals(model: Model, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of the toxic state for each token; all texts go forward and back in step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0) for _ in scores]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    odds = np.exp(np.clip(np.concatenate([scores[i] for i in order]), -30, 30))
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
    ahead = np.empty_like(odds)
    (m00, m01), (m10, m11) = model.move
    ratio = odds[first[: active[0]]] * np.exp(model.start)
    ahead[first[: active[0]]] = ratio
    for t in range(1, sizes[0]):
        at = first[: active[t]] + t
        ratio = ratio[: active[t]]
        ratio = odds[at] * (m01 + ratio * m11) / (m00 + ratio * m10)
        ahead[at] = ratio
    back = np.ones(active[0])
    out = np.empty_like(odds)
    for t in range(sizes[0] - 1, -1, -1):
        at = first[: active[t]] + t
        now = back[: active[t]]
        joint = ahead[at] * now
        out[at] = joint / (1 + joint)
        seen = odds[at] * now
        back[: active[t]] = (m10 + m11 * seen) / (m00 + m01 * seen)
    ends = np.cumsum(sizes)
    parts = [None] * len(scores)
    for k, i in enumerate(order):
        parts[i] = out[first[k] : ends[k]]
    return parts


def window_slopes(ids: np.ndarray, real: np.ndarray, truth: np.ndarray, of_word: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """For some windows: what each word's weight should gain, and the expected number of each move."""
    length = len(ids)
    odds = np.exp(np.clip(of_word[ids], -30, 30))
    ahead, back = np.empty(ids.shape), np.ones(ids.shape)
    ahead[0] = odds[0] * np.exp(start)
    for t in range(1, length):
        ahead[t] = odds[t] * (move[0, 1] + ahead[t - 1] * move[1, 1]) / (move[0, 0] + ahead[t - 1] * move[1, 0])
    for t in range(length - 1, 0, -1):
        seen = odds[t] * back[t]
        back[t - 1] = np.where(real[t], (move[1, 0] + move[1, 1] * seen) / (move[0, 0] + move[0, 1] * seen), 1.0)
    p = ahead * back / (1 + ahead * back)
    gap = np.where(real, truth - p, 0.0)
    seen = odds[1:] * back[1:]
    joint = np.stack([np.full_like(seen, move[0, 0]), move[0, 1] * seen, ahead[:-1] * move[1, 0], ahead[:-1] * move[1, 1] * seen])
    expected = (joint / joint.sum(axis=0) * real[1:]).sum(axis=(1, 2))
    return np.bincount(ids.ravel(), gap.ravel(), minlength=len(of_word)), expected


def fit_chain(windows: list[tuple[str, str]]) -> Model:
    """Maximum likelihood with a small decay, by adaptive gradient steps over all windows.

    A window is its words, separated by blanks, and a digit for the label of each.
    """
    number: dict[str, int] = {}
    n, length = len(windows), max(len(truth) for _, truth in windows)
    ids, real, truth = np.zeros((length, n), dtype=np.int32), np.zeros((length, n), dtype=bool), np.zeros((length, n), dtype=np.uint8)
    for k, (text, marks) in enumerate(windows):
        ids[: len(marks), k] = [number.setdefault(w, len(number)) for w in text.split(" ")]
        real[: len(marks), k], truth[: len(marks), k] = True, np.frombuffer(marks.encode(), np.uint8) - ord("0")
    lists = [np.array(features(w), dtype=np.int32) for w in number]
    owner, places = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    seen_moves = np.array([((truth[:-1] == i) & (truth[1:] == j) & real[1:]).sum() for i in (0, 1) for j in (0, 1)])
    weight, logs, start = np.zeros(BUCKETS), np.zeros(4), -2.0
    sums_w, sums_l = np.full(BUCKETS, 1e-8), np.full(4, 1e-8)
    total = real.sum()
    for _ in range(ROUNDS):
        move = np.exp(logs).reshape(2, 2)
        of_word = np.bincount(owner, weight[places], minlength=len(lists))
        gain, expected = np.zeros(len(lists)), np.zeros(4)
        for at in range(0, n, WINDOWS_AT_ONCE):
            some = slice(at, at + WINDOWS_AT_ONCE)
            part, moves = window_slopes(ids[:, some], real[:, some], truth[:, some], of_word, move, start)
            gain += part
            expected += moves
        slope = np.bincount(places, gain[owner], minlength=BUCKETS) / total - DECAY * weight
        slope_l = (seen_moves - expected) / total - DECAY * logs
        sums_w += slope**2
        sums_l += slope_l**2
        weight += STEP * slope / np.sqrt(sums_w)
        logs += 0.1 * slope_l / np.sqrt(sums_l)
    return Model(weight.astype(np.float32), np.exp(logs).reshape(2, 2), start)


def inputs(p: np.ndarray) -> list[float]:
    """What a text's marginals say about it as a whole."""
    return [1.0, float(np.log(p.sum() + 1e-4)), float(p.max(initial=0.0)), float(np.log1p(len(p)))]


def fit_calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the weights restore the labels' shares in all rows."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the training fold."""
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))


def training_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, held``: the bounded training sample; ``held`` rows are kept for the calibration."""
    known = training_labels(labels)
    place = F.xxhash64("doc_id", F.lit("train"))
    some = [known.where(F.col("toxic") == y).orderBy(place, "doc_id").limit(DOCS_EACH) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * DOCS_EACH rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    return cut_lineage(rows.select("text", "toxic", (F.pmod(place, F.lit(3)) == 0).alias("held")))


def seed_signs(sample: DataFrame) -> set[str]:
    """Signs that mark toxic documents: few documents without the label have them.

    Where none is frequent and telling enough, all count that toxic documents have more often.
    """

    def count(stream):
        for batch in batches(stream):
            counts = Counter()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                for sign in {s for w in set(TOKEN.findall(text.lower())) for s in signs(w)}:
                    counts[sign, int(toxic)] += 1
            yield pa.RecordBatch.from_pydict({"sign": [s for s, _ in counts], "toxic": pa.array([t for _, t in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    total = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return set()
    counts = sample.select("text", "toxic").mapInArrow(count, "sign string, toxic int, n long").groupBy("sign")
    both = counts.agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (total[1] + 1)) - F.log((F.col("good") + 0.5) / (total[0] + 1))
    sure = (F.col("bad") >= SEED_DOCS) & (F.col("odds") >= SEED_ODDS)
    best = both.withColumn("odds", odds).where("bad > 0 AND odds > 0").withColumn("sure", sure)
    rows = best.orderBy(F.desc("sure"), F.desc("odds"), F.desc("bad"), "sign").limit(SEEDS).collect()
    return {r["sign"] for r in rows if r["sure"]} or {r["sign"] for r in rows}


def training_windows(sample: DataFrame, seeds: set[str]) -> list[tuple[str, str]]:
    """Labelled windows: those with toxic tokens first, then others spread over the text."""

    def cut(stream):
        for batch in batches(stream):
            rows = []
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                words = TOKEN.findall(text.lower())
                truth = [int(bool(toxic) and not seeds.isdisjoint(signs(w))) for w in words]
                starts = range(0, len(words), WINDOW)
                marked = [s for s in starts if any(truth[s : s + WINDOW])]
                plain = [s for s in starts if not any(truth[s : s + WINDOW])]
                some = (marked + plain[:: max(1, len(plain) // 3)])[:WINDOWS_EACH]
                rows += [(" ".join(words[s : s + WINDOW]), "".join(map(str, truth[s : s + WINDOW]))) for s in some]
            yield pa.RecordBatch.from_pydict({"words": pa.array([w for w, _ in rows], pa.string()), "truth": pa.array([t for _, t in rows], pa.string())})

    rows = sample.select("text", "toxic").mapInArrow(cut, "words string, truth string").toArrow()
    return sorted(zip(rows["words"].to_pylist(), rows["truth"].to_pylist()))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the training fold of ``labels``; None without both kinds of label."""
    sample = training_docs(docs, labels)
    chain_rows, held_rows = sample.where("NOT held"), sample.where("held")
    seeds = seed_signs(chain_rows)
    windows = training_windows(chain_rows, seeds) if seeds else []
    if not windows:
        return None
    model = fit_chain(windows)

    def sum_up(stream):
        for batch in batches(stream):
            found = marginals(model, [model.emission(TOKEN.findall(t.lower())) for t in texts_of(batch)])
            yield pa.RecordBatch.from_pydict({"x": pa.array([inputs(p) for p in found], pa.list_(pa.float64())), "toxic": pa.array(batch.column("toxic").to_pylist(), pa.int32())})

    rows = held_rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(sum_up, "x array<double>, toxic int").collect()
    rows = sorted((r["x"], r["toxic"]) for r in rows)
    x, y = np.array([r[0] for r in rows] or [inputs(np.zeros(0))]), np.array([r[1] for r in rows] or [0])
    if len(set(y.tolist())) < 2:  # too few documents to set some aside
        x, y = np.array([inputs(np.zeros(1)), inputs(np.ones(1))] * 50), np.array([0, 1] * 50)
    shares = {int(r["toxic"]): r["n"] for r in training_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, shares[1] / max((y == 1).sum(), 1), shares[0] / max((y == 0).sum(), 1))
    model.calibration = fit_calibration(x, y, weight * len(y) / weight.sum())
    return model


def held_out(doc_id):
    """Rows that training never sees, by their id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def tag(docs: DataFrame, model: Model | None, score: str = "score", spans: str = "spans") -> DataFrame:
    """Every row of ``docs`` with a score from 0 to 1 and its toxic spans (code points, end exclusive)."""

    def make():
        def call(texts):
            if model is None:
                found = [np.zeros(0)] * len(texts)
                values = [0.0] * len(texts)
            else:
                found = marginals(model, [model.emission(TOKEN.findall(t.lower())) for t in texts])
                x = np.array([inputs(p) for p in found]).reshape(len(texts), 4)
                values = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
            marked = []
            for text, p in zip(texts, found):
                hot = set(np.flatnonzero(p >= 0.5).tolist())
                lowered = text.lower()
                places = TOKEN.finditer(lowered if len(lowered) == len(text) else text) if hot else ()
                marked.append([{"start": m.start(), "end": m.end(), "p": float(p[i])} for i, m in enumerate(places) if i in hot])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            return [pa.array(values, pa.float64()), pa.array(marked, kind)]

        return call

    return add_columns(docs, [(score, DoubleType()), (spans, ArrayType(SPAN))], make, rows=TEXTS)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the limit."""
    score, spans = free_name(docs, "score"), free_name(docs, "spans")
    scored = tag(docs, train(docs, labels), score, spans)
    return scored.where(F.col(score) < limit).drop(score, spans)
