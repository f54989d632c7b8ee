"""Byte-pair merges of a vocabulary file with word ends.

The file names a normaliser (NFC, white space, lower case), a splitting pattern and
merges; ``WordBpe`` follows it, so that ids equal those of the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"  # Unicode white space
BEYOND_LATIN = re.compile("[^\x00-\u024f]")  # libraries differ in how new their Unicode tables are
NOT_SPACES = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the pattern doesn't


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for extra, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + extra)
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=1)
def letter_bytes() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(byte_letters())}


NEVER = 1 << 30  # the rank of a pair that isn't merged
SHORT = 64  # letters of a piece up to which pieces are merged side by side
ROWS = 8192  # pieces merged side by side


def merge_long(ids: list[int], ranks: dict[tuple[int, int], int], made: np.ndarray) -> list[int]:
    """Merges the pair of lowest rank, leftmost first, until none is left: n log n steps."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or ranks.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j] = int(made[rank]), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((ids[i], ids[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((ids[h], ids[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return [x for x in ids if x >= 0]


class WordBpe:
    """Splitting and merging by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        keys = np.array([(a << 32) | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], np.array(list(self.ranks.values()), dtype=np.int32)[order]
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.inner = np.array([self.vocab[x] for x in byte_letters()], dtype=np.int32)
        self.last = np.array([self.vocab[x + self.end] for x in byte_letters()], dtype=np.int32)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        self.pattern, self.pattern_or_line = regex.compile(pattern), regex.compile(pattern + "|\n")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def segments(self, text: str) -> list[str]:
        """Odd places hold special tokens, even places ordinary text."""
        return self.split_special.split(text) if self.split_special and "<|" in text else [text]

    def chunks(self, text: str) -> list[str]:
        """Normalised text cut at white space; no piece crosses such a cut."""
        if BEYOND_LATIN.search(text):
            text = self.library.normalizer.normalize_str(text)
        elif not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        return text.split() if not NOT_SPACES.search(text) else [c for c in re.split(f"[{SPACES}]+", text) if c]

    def pieces(self, chunk: str) -> list[str]:
        """The parts that are merged on their own."""
        if chunk.isalpha() and chunk.isascii():
            return [chunk]
        if BEYOND_LATIN.search(chunk):
            found = self.library.pre_tokenizer.pre_tokenize_str(chunk)
            return [bytes(map(letter_bytes().__getitem__, piece)).decode("utf-8") for piece, _ in found]
        return self.pattern.findall(chunk)

    def pieces_of(self, chunks: list[str]) -> tuple[list[str], list[str], np.ndarray]:
        """The chunks in another order, all their pieces one after the other, and how many each chunk has."""
        beyond = [c for c in chunks if not c.isascii() and BEYOND_LATIN.search(c)]
        if beyond:
            apart = set(beyond)
            chunks = [c for c in chunks if c not in apart]
        # no chunk has a line break, so one search over a line for each chunk finds the pieces of each
        found = self.pattern_or_line.findall("".join([c + "\n" for c in chunks]))
        sizes = np.diff([i for i, p in enumerate(found) if p == "\n"], prepend=-1) - 1 if chunks else np.zeros(0, np.int64)
        found = [p for p in found if p != "\n"]
        split = [self.pieces(c) for c in beyond]
        return chunks + beyond, found + [p for some in split for p in some], np.append(sizes, [len(some) for some in split]).astype(np.int64)

    def letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces' bytes, one after the other, and the number of each piece's bytes."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        each = np.frombuffer(b"".join(data), dtype=np.uint8)
        ids, last = self.inner[each], np.cumsum(sizes) - 1
        ids[last] = self.last[each[last]]
        return ids, sizes

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NEVER where there is no such merge or no such letter (-1)."""
        pair = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], NEVER)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By merging alone: an array with all ids, and where each piece's ids start in it and how many they are.

        Short pieces of about the same length form a table with one piece a row; each
        round merges, in every row, the leftmost pair of lowest rank.
        """
        ids, sizes = self.letters(pieces)
        starts, left = np.cumsum(sizes) - sizes, sizes.copy()
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, SHORT)):
            rows, columns = np.flatnonzero((sizes > low) & (sizes <= high)), np.arange(high)
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                inside, place = columns < sizes[some][:, None], starts[some][:, None] + columns
                table = np.full((len(some), high), -1, dtype=np.int32)
                table[inside] = ids[place[inside]]
                left[some] = self.merge_table(table)
                inside = columns < left[some][:, None]
                ids[place[inside]] = table[inside]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            row = merge_long(ids[starts[i] : starts[i] + sizes[i]].tolist(), self.ranks, self.made)
            ids[starts[i] : starts[i] + len(row)], left[i] = row, len(row)
        return ids, starts, left

    def merge_table(self, table: np.ndarray) -> np.ndarray:
        """Merges every row of ``table`` in place; how many ids each row has left."""
        open_rows, part, ranks = np.arange(len(table)), table, self.rank_of(table[:, :-1], table[:, 1:])
        columns = np.arange(table.shape[1] - 1)
        while True:
            where = ranks.argmin(axis=1)
            best = ranks[np.arange(len(part)), where]
            go = best < NEVER
            if not go.all():
                table[open_rows[~go]] = part[~go]
                open_rows, part, ranks, where, best = open_rows[go], part[go], ranks[go], where[go], best[go]
            if not len(open_rows):
                return (table >= 0).sum(axis=1)
            line, later = np.arange(len(part)), columns > where[:, None]
            merged = np.full_like(part, -1)
            merged[:, :-1] = np.where(later, part[:, 1:], part[:, :-1])
            merged[line, where] = self.made[best]
            shifted = np.full_like(ranks, NEVER)
            shifted[:, :-1] = np.where(later[:, 1:], ranks[:, 1:], ranks[:, :-1])
            right, left = np.minimum(where, len(columns) - 1), np.maximum(where - 1, 0)
            shifted[line, right] = self.rank_of(merged[line, right], merged[line, right + 1])
            shifted[line, left] = self.rank_of(merged[line, left], merged[line, left + 1])
            part, ranks = merged, shifted


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One copy of the vocabulary in each worker process."""
    return WordBpe(path)
