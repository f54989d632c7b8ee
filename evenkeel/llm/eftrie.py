"""A trigram trie in Elias-Fano coded levels that can be mapped into memory.

Levels of one trie, all of them rising sequences:

- ``words``: the last words w2 of the contexts;
- ``contexts``: under each w2 the words w1 before it, with the smoothed bigram
  probability of w2 after w1 and the weight that the context leaves to shorter ones;
- ``successors``: under each w2 the words that follow it in some context;
- ``grams``: under each context (w1, w2) its successors w3, not as words but as their
  places among the successors of w2, with the context's share of their probability.

A trigram is found by searching w2, w1 below it, w3 among the successors of w2, and that
place below the context. Sequences are made to rise over ranges by an offset for each
range, so a search is one look at the high bits and a short search in the low ones.
Probabilities are 16-bit codes of their logarithms. All calls take arrays.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

SCALE = 128  # codes a unit of the decimal logarithm
NOTHING = 65535  # the code of 0


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * SCALE)
    return np.minimum(code, NOTHING).astype(np.uint16)


PROBABILITIES = np.append(10.0 ** (-np.arange(NOTHING, dtype=np.float64) / SCALE), 0.0)


def probability(code: np.ndarray) -> np.ndarray:
    return PROBABILITIES[code]


def starts_run(values: np.ndarray) -> np.ndarray:
    """Where a rising sequence has a value that the place before doesn't have."""
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return first


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits, one after the other in 64-bit words."""
    if not bits:
        return np.zeros(1, np.uint64)
    rows = -(-len(values) // 64)
    grid = np.zeros(rows * 64, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, 64)
    out = np.zeros((rows, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= grid[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= grid[:, lane] >> np.uint64(64 - shift)
    return np.append(out.ravel(), np.uint64(0))


def unpacked(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(bits)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(shift == 0, np.uint64(0), words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
    return ((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)


class EliasFano:
    """A rising sequence of numbers below 2^63."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        flags = np.unpackbits(high, bitorder="little")
        self.closed = np.flatnonzero(flags == 0).astype(np.int32 if len(flags) < 1 << 31 else np.int64)  # where each bucket ends

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        tops = (values >> np.uint64(bits)).astype(np.int64)
        length = (int(tops[-1]) if n else 0) + n + 1
        flags = np.zeros(-(-length // 8) * 8, np.uint8)
        flags[tops + np.arange(n)] = 1
        return n, bits, packed(values & np.uint64((1 << bits) - 1), bits), np.packbits(flags, bitorder="little")

    def all(self) -> np.ndarray:
        at = np.arange(self.n)
        tops = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - at
        return (tops << self.bits) | unpacked(self.low, self.bits, at).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return out
        tops = values >> self.bits
        inside = np.flatnonzero((values >= 0) & (tops < len(self.closed)))
        tops, wanted = tops[inside], (values[inside] & ((1 << self.bits) - 1)).astype(np.uint64)
        end = np.minimum(self.closed[tops] - tops, self.n)
        lo = np.where(tops > 0, self.closed[np.maximum(tops - 1, 0)] - tops + 1, 0)
        hi, open_ = end.copy(), np.flatnonzero(lo + 1 < end)
        while len(open_):
            low, high = lo[open_], hi[open_]
            mid = (low + high) >> 1
            less = unpacked(self.low, self.bits, mid) < wanted[open_]
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            lo[open_], hi[open_] = low, high
            open_ = open_[low + 1 < high]
        one = np.flatnonzero(lo < hi)
        one = one[unpacked(self.low, self.bits, lo[one]) < wanted[one]]
        lo[one] += 1
        there = np.flatnonzero(lo < end)
        there = there[unpacked(self.low, self.bits, lo[there]) == wanted[there]]
        out[inside[there]] = lo[there]
        return out


class Trie:
    """Searches in a trie made by ``compiled``."""

    def __init__(self, data):
        head = np.frombuffer(data, np.int64, 26)
        parts, at = [], 26 * 8
        for k in range(10):  # low and high bits of five sequences
            kind = np.uint64 if k % 2 == 0 else np.uint8
            parts.append(np.frombuffer(data, kind, int(head[k]), at))
            at += -(-parts[-1].nbytes // 8) * 8
        self.words, self.contexts, self.context_ends, self.successors, self.successor_ends = (EliasFano(int(head[10 + 2 * k]), int(head[11 + 2 * k]), parts[2 * k], parts[2 * k + 1]) for k in range(5))
        n_contexts, n_grams = int(head[20]), int(head[21])
        low, high = int(head[22]), int(head[23])
        self.stride = int(head[24])
        grams_low = np.frombuffer(data, np.uint64, low, at)
        at += low * 8
        grams_high = np.frombuffer(data, np.uint8, high, at)
        at += -(-high // 8) * 8
        self.grams = EliasFano(n_grams, int(head[25]), grams_low, grams_high)
        codes = np.frombuffer(data, np.uint16, 2 * n_contexts + n_grams, at)
        self.bigram, self.left, self.share = codes[:n_contexts], codes[n_contexts : 2 * n_contexts], codes[2 * n_contexts :]
        self.first_context, self.first_successor = self.context_ends.all(), self.successor_ends.all()
        self.width = np.diff(self.first_successor)
        self.offset = np.concatenate([[0], np.cumsum(np.diff(self.first_context) * self.width)])

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie over a memory map of an unnamed file."""
        file = tempfile.TemporaryFile()
        file.write(data)
        file.flush()
        return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find_contexts(self, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each context (or -1) and the rank of its w2."""
        rank = self.words.find(w2)
        return np.where(rank < 0, -1, self.contexts.find(np.where(rank < 0, -1, rank * self.stride + w1))), rank

    def find_grams(self, context: np.ndarray, rank: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """Place of each word below its context, or -1."""
        known = context >= 0
        r = np.where(known, rank, 0)
        place = self.successors.find(np.where(known, r * self.stride + w3, -1))
        target = self.offset[r] + (context - self.first_context[r]) * self.width[r] + (place - self.first_successor[r])
        return self.grams.find(np.where(place < 0, -1, target))


def compiled(w1: np.ndarray, w2: np.ndarray, gram_context: np.ndarray, w3: np.ndarray, bigram: np.ndarray, left: np.ndarray, share: np.ndarray) -> bytes:
    """A trie of contexts sorted by (w2, w1) and of grams sorted by (context, w3); at least one of each."""
    stride = int(max(w1.max(), w3.max())) + 1
    first = starts_run(w2)
    words, rank = w2[first], np.cumsum(first) - 1
    if len(words) * stride >= 1 << 62:
        raise ValueError("too many words for one trie; use more shards")
    context_ends = np.searchsorted(rank, np.arange(len(words) + 1))
    follow = rank[gram_context] * stride + w3
    successors = np.sort(follow)
    successors = successors[starts_run(successors)]
    successor_ends = np.searchsorted(successors, np.arange(len(words) + 1) * stride)
    width = np.diff(successor_ends)
    offset = np.concatenate([[0], np.cumsum(np.diff(context_ends) * width)])
    r = rank[gram_context]
    grams = offset[r] + (gram_context - context_ends[r]) * width[r] + np.searchsorted(successors, follow) - successor_ends[r]
    sequences = [EliasFano.parts(x) for x in (words, rank * stride + w1, context_ends, successors, successor_ends)]
    last = EliasFano.parts(grams)
    head = [len(p) for s in sequences for p in s[2:]] + [v for s in sequences for v in s[:2]] + [len(w1), len(w3), len(last[2]), len(last[3]), stride, last[1]]
    out = [np.array(head, np.int64).tobytes()]
    for part in [p for s in [*sequences, last] for p in s[2:]] + [np.concatenate([bigram, left, share]).astype(np.uint16)]:
        raw = part.tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)
