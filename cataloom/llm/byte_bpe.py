"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is encoded once per task batch. All new pre-tokens of a batch lie one after the other as linked
lists in arrays. Every merge rank has a bucket of list positions whose pair merges to that rank; a
three-level bitmap over the ranks gives the next rank by find-first-set. The positions of a bucket are merged
together; entries whose pair has changed since are stale and skipped. Pre-tokens do not touch each other,
so this is the order in which each of them alone would be merged. Only where a merge makes a pair of lower
rank in a pre-token with several merges of this rank could the order matter; such a pre-token is encoded again alone, with
a queue of the same kind whose buckets give one place at a time, leftmost first.

The vocabulary is a rank file (base64 token, rank); its path is a parameter. Defined results: null text is
empty (no ids); repeated rows are encoded alike; rows without doc_id are encoded too.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc

#: Pre-tokens that a task remembers; beyond that it starts afresh, so memory is bounded.
REMEMBERED = 200_000
#: Bytes of text whose new pre-tokens are encoded together.
GROUP = 4 << 20


class Ranks:
    """Tokens of a rank file and, for each pair of tokens, the rank of their concatenation."""

    def __init__(self, lines: bytes):
        self.tokens: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[base64.b64decode(token)] = int(rank)
        self.bytes = {rank: token for token, rank in self.tokens.items()}
        self.size = max(self.bytes) + 1
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.tokens[t[:i]] * self.size + self.tokens[t[i:]], r) for t, r in self.tokens.items() for i in range(1, len(t)) if t[:i] in self.tokens and t[i:] in self.tokens]
        pairs.sort()
        self.pair, self.rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no token."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merges in order of rank, then place, stale entries skipped."""
        ids, n = [self.tokens[bytes([b])] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part = [bytes([b]) for b in word]
        live, queue = [True] * n, PlaceQueue(self.size)
        for i in range(n - 1):
            if (r := self.tokens.get(part[i] + part[i + 1])) is not None:
                queue.push(r, i)
        while (item := queue.pop()) is not None:
            rank, i = item
            j = after[i] if live[i] else n
            if j >= n or self.tokens.get(part[i] + part[j]) != rank:
                continue
            part[i], ids[i], live[j], after[i] = part[i] + part[j], rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.tokens.get(part[k] + part[after[k]])) is not None:
                    queue.push(r, k)
        return [x for x, keep in zip(ids, live, strict=True) if keep]


class Bitmap:
    """The ranks that have entries: 64-bit words, words of words, and one top word, so that find-first-set gives the least."""

    def __init__(self, size: int):
        self.low, self.mid, self.top = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def least(self) -> int | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1

    def drop(self, rank: int) -> None:
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))


class PlaceQueue:
    """Buckets of single places by rank, for one pre-token; a bucket gives its leftmost place first."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.ranks = Bitmap(size)

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [place]
            self.ranks.add(rank)
        else:
            heapq.heappush(bucket, place)

    def pop(self) -> tuple[int, int] | None:
        rank = self.ranks.least()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        place = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.ranks.drop(rank)
        return rank, place


class RankQueue:
    """Buckets of arrays of positions by rank, for many pre-tokens at once."""

    def __init__(self, size: int):
        self.buckets: list[list[np.ndarray]] = [[] for _ in range(size)]
        self.ranks = Bitmap(size)

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for at, end in zip(cuts, [*cuts[1:], len(ranks)], strict=True):
            rank = int(ranks[at])
            self.buckets[rank].append(places[at:end])
            self.ranks.add(rank)

    def pop(self) -> tuple[int, np.ndarray] | None:
        rank = self.ranks.least()
        if rank is None:
            return None
        self.ranks.drop(rank)
        places, self.buckets[rank] = self.buckets[rank], []
        if len(places) == 1:
            return rank, places[0]
        all_places = np.sort(np.concatenate(places))
        return rank, all_places[np.concatenate([[True], all_places[1:] != all_places[:-1]])]


def encode_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens one after the other, and where each begins."""
    whole = {i: r for i, w in enumerate(words) if (r := ranks.tokens.get(w)) is not None}
    rest = [i for i in range(len(words)) if i not in whole]
    sizes = np.array([len(words[i]) for i in rest], np.int64)
    data = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
    n, owner = len(data), np.repeat(np.arange(len(rest)), sizes)
    ids = np.append(ranks.single[data], 0) if n else np.zeros(1, np.int64)
    after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    again: set[int] = set()
    last = np.zeros(n, bool)
    last[np.cumsum(sizes) - 1] = True
    current = np.full(n, -1, np.int64)  # rank of the pair that begins at a place
    inner = np.flatnonzero(~last)
    current[inner] = ranks.of(ids[inner], ids[inner + 1])
    queue = RankQueue(ranks.size)
    some = inner[current[inner] >= 0]
    queue.push(current[some], some)
    owner_end, merged = np.append(owner, -1), np.zeros(n, bool)
    while (item := queue.pop()) is not None:
        rank, at = item
        at = at[live[at] & (current[at] == rank)]
        if not len(at):
            continue
        if len(at) > 1:  # of pairs that overlap, the first, third, ... of a run
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        ids[at], live[gone], current[gone] = rank, False, -1
        after[at] = after[gone]
        follow = after[at]
        inside = follow < n
        before[follow[inside]] = at[inside]
        left = before[at]
        left = left[(left >= 0)]
        left = left[owner[left] == owner_end[after[left]]]
        merged[at] = True
        near = np.sort(np.concatenate([at, left[~merged[left]]]))
        merged[at] = False
        right = after[near]
        joined = owner_end[right] == owner[near]
        new = np.full(len(near), -1, np.int64)
        new[joined] = ranks.of(ids[near[joined]], ids[right[joined]])
        current[near] = new
        push = new >= 0
        queue.push(new[push], near[push])
        if push.any() and new[push].min() < rank:
            mine = owner[at]
            several = mine[1:][mine[1:] == mine[:-1]]
            again.update(np.intersect1d(several, owner[near[push & (new < rank)]]).tolist())
    counts = np.ones(len(words), np.int64)
    per_rest = np.bincount(owner[live], minlength=len(rest)) if n else np.zeros(len(rest), np.int64)
    redone = {i: ranks.alone(words[rest[i]]) for i in again}
    for i, x in redone.items():
        per_rest[i] = len(x)
    counts[rest] = per_rest
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1], np.int64)
    if whole:
        at = np.fromiter(whole, np.int64, len(whole))
        out[first[at]] = np.fromiter(whole.values(), np.int64, len(whole))
    if n:
        good = live & ~np.isin(owner, list(redone)) if redone else live
        which, value = owner[good], ids[:n][good]
        starts = np.searchsorted(which, np.arange(len(rest)))
        out[first[np.array(rest)][which] + np.arange(len(which)) - starts[which]] = value
    for i, x in redone.items():
        out[first[rest[i]] : first[rest[i]] + len(x)] = x
    return out, first


class Encoder:
    """Encodes texts through remembered pre-tokens."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.decimal = [str(x).encode() for x in range(ranks.size)]
        self.plain = [ranks.bytes.get(x, b"") for x in range(ranks.size)]
        self._reset()

    def _reset(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > REMEMBERED:
            self._reset()
        numbers = []
        for text in texts:
            found = self.find(text)
            numbers.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        new = list(islice(self.number, len(self.first) - 1, None))
        if new:
            ids, first = encode_words([w.encode() for w in new], self.ranks)
            self.first = np.concatenate([self.first, first[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        for index in numbers:
            size = self.first[index + 1] - self.first[index]
            ends = np.cumsum(size)
            yield self.ids[np.repeat(self.first[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


#: The encoder of this Python process, which serves one task after another.
_encoders: dict[tuple, Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(lines).digest(), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Ranks(lines), pattern)
    return _encoders[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(batches: Iterator[pa.RecordBatch], lines: bytes, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
    encoder = None
    for batch in batches:
        tc.release()
        encoder = encoder or _encoder(lines, pattern)
        for low, high in tc.slices(tc.text_buffer(batch.column("text"))[1], GROUP):
            part = batch.slice(low, high - low)
            texts = [x or "" for x in part.column("text").to_pylist()]
            rows, found = [], []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                index = ids.tolist()
                decoded = b"".join(map(encoder.plain.__getitem__, index))
                rows.append((len(index), hashlib.sha256(b",".join(map(encoder.decimal.__getitem__, index))).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == text.encode()))
                found.append(ids.astype(np.int32))
            columns = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            if with_ids:
                columns.append(tc.list_array(np.concatenate(found), np.cumsum([0, *map(len, found)]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])
    tc.release()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, same) of every row; with ``with_ids`` also ids array<int>.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the bytes that the ids decode to;
    same tells whether those are the text's own bytes.
    """
    # The rank file is part of an installed package of about half a megabyte and goes to the tasks as bytes.
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, shared.value, pattern, with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
