"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Documents and items are sequences of five-word shingles. For each of a geometric series of window sizes a
document's windows (every eighth of a size) get 64-bit SimHash fingerprints from running bit counts. Fingerprints
are cut in ``BLOCKS`` 16-bit blocks; each item is listed in each block's table under every value within
``RADIUS // BLOCKS`` bits of its own, so every item within ``RADIUS`` bits of a window is found. Around
each such window, windows of the item's own size are compared exactly: a weighted Jaccard similarity of shingle
sets of 0.8 or more is a leak. A shingle that df items share weighs 1/(1+ln df), others weigh 1.

A running count of shingles known from any item comes first: a window with under half of its shingles known
cannot reach 0.8 (it would need four fifths, less an eighth for alignment) and gets no fingerprint.

Items go to tasks in groups of about ``GROUP_BYTES`` of text, one after the other over the same rows: the documents are read once.
Defined results: null text is empty; an item of one to four words is one shingle, which only a document of just those
words has; items without a word match nothing; rows without doc_id are
searched too, their doc_id stays null; repeated rows give repeated leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc

SHINGLE, SIMILARITY, RADIUS, BLOCKS, RATIO = 5, 0.8, 15, 4, 1.12
GROUP_BYTES = 16 << 20
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def simhash(hashes: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles that begin at ``begin``: majority of each bit."""
    counts = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=counts[1:])
    return _majority(counts, begin, size)


def _majority(counts: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    return np.packbits((counts[begin + size] - counts[begin]) * 2 > size, axis=1).reshape(-1).view(np.uint64)


def prints(hashes: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """``simhash`` of sorted windows of a document of any length, in stretches."""
    out, low = [], 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + COUNTED)))
        base = begin[low]
        out.append(simhash(np.ascontiguousarray(hashes[base : begin[high - 1] + size]), begin[low:high] - base, size))
        low = high
    return np.concatenate(out)


class Items:
    """Items with their shingle sets, weights, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        table = pa.array(texts, pa.string())
        data, offsets = tc.text_buffer(table)
        words = tc.words(data, offsets)
        hashes, first = tc.ngrams(words.hash, words.first, SHINGLE)
        size = np.diff(first)
        good = np.flatnonzero(size > 0)
        self.ids, self.size = [ids[i] for i in good], size[good]
        parts = [hashes[first[i] : first[i + 1]] for i in good]
        self.sets = [frozenset(p.tolist()) for p in parts]
        known, df = np.unique(np.concatenate([np.unique(p) for p in parts]) if parts else np.zeros(0, np.uint64), return_counts=True)
        self.known = known
        self.weight = dict(zip(known.tolist(), (1 / (1 + np.log(df))).tolist(), strict=True))
        self.series = np.round(np.log(np.maximum(self.size, 1)) / np.log(RATIO)).astype(int)
        self.print = np.array([simhash(p, np.zeros(1, np.int64), len(p))[0] for p in parts], np.uint64)
        reach = RADIUS // BLOCKS
        masks = np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(16), n)], np.uint64)
        self.tables = []
        for block in range(BLOCKS):
            value = (self.print >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            listed = (value[:, None] ^ masks).ravel()
            owner = np.repeat(np.arange(len(self.ids)), len(masks))
            order = np.argsort(listed, kind="stable")
            self.tables.append((listed[order], owner[order]))
        bits = np.zeros(1 << 20, bool)
        bits[(known >> np.uint64(44)).astype(np.int64)] = True
        self.filter = bits

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        out = self.filter[(hashes >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == hashes[maybe]
        return out

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and distances of all pairs within RADIUS."""
        pairs = []
        for block, (listed, owner) in enumerate(self.tables):
            value = (prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            low, high = np.searchsorted(listed, value, "left"), np.searchsorted(listed, value, "right")
            n = high - low
            window = np.repeat(np.arange(len(prints)), n)
            pairs.append(window * len(self.ids) + owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.print[item])
        near = distance <= RADIUS
        return window[near], item[near], distance[near]

    def similarity(self, item: int, window: list[int]) -> float:
        other, mine, weigh = set(window), self.sets[item], self.weight
        both = sum(weigh[h] for h in other & mine)
        return both / (sum(weigh.get(h, 1.0) for h in other) + sum(weigh[h] for h in mine) - both)


def find_leaks(data: np.ndarray, offsets: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[float, int]]:
    """(document, item) -> (similarity, first word) of the leaks in a buffer of texts."""
    words = tc.words(data, offsets)
    hashes, first = tc.ngrams(words.hash, words.first, SHINGLE)
    hits = np.concatenate([[0], np.cumsum(items.knows(hashes))])
    some = np.flatnonzero(hits[first[1:]] > hits[first[:-1]])
    candidates: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc in some.tolist():
        low, high = int(first[doc]), int(first[doc + 1])
        mine, known = hashes[low:high], hits[low : high + 1] - hits[low]
        bits = None
        for series in np.unique(items.series).tolist():
            size = min(max(1, round(RATIO**series)), high - low)
            begin = np.unique(np.append(np.arange(0, high - low - size + 1, max(1, size // 8)), high - low - size))
            begin = begin[(known[begin + size] - known[begin]) * 2 >= size]
            if not len(begin):
                continue
            if high - low > COUNTED:
                found_prints = prints(mine, begin, size)
            else:
                if bits is None:
                    bits = np.zeros((high - low + 1, 64), np.int32)
                    np.cumsum(np.unpackbits(mine.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=bits[1:])
                found_prints = _majority(bits, begin, size)
            for w, i, distance in zip(*items.within(found_prints), strict=True):
                if abs(items.series[i] - series) <= 1:
                    candidates.setdefault((doc, int(i)), []).append((int(distance), int(begin[w])))
    found = {}
    for (doc, item), places in candidates.items():
        low, high = int(first[doc]), int(first[doc + 1])
        size, tried, best = int(items.size[item]), set(), (0.0, 0)
        for _, at in sorted(places):
            reach = size // 4 + 2
            for begin in range(max(0, at - reach), max(0, min(at + reach, high - low - size)) + 1):
                if begin not in tried:
                    tried.add(begin)
                    score = items.similarity(item, hashes[low + begin : min(low + begin + size, high)].tolist())
                    best = max(best, (score, -begin))
            if best[0] >= SIMILARITY:
                break
        if best[0] >= SIMILARITY - 1e-12:
            found[doc, item] = (best[0], -best[1])
    return found


def item_groups(benchmark: DataFrame) -> Iterator[Items]:
    """Items in groups of bounded text; the driver holds one group at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    n = total // GROUP_BYTES + 1
    for i in range(n):
        group = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in group], [r["text"] for r in group])


_LEAKS = "array<struct<item_id:bigint,similarity:double,first_word:bigint>>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for every document and item that leak into it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast(_LEAKS).alias("leaks"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))
    for items in item_groups(benchmark):
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tc.release()
                data, offsets = tc.text_buffer(batch.column("text"))
                known: dict[int, list] = {}
                for low, high in tc.slices(offsets):
                    for (d, i), (s, w) in find_leaks(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shared.value).items():
                        known.setdefault(low + d, []).append({"item_id": shared.value.ids[i], "similarity": s, "first_word": w})
                before = batch.column("leaks")
                now = pa.array([before[n].as_py() + known[n] if n in known else before[n].as_py() for n in range(batch.num_rows)], kind) if known else before
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), now], ["doc_id", "text", "leaks"])

        rows = rows.mapInArrow(search, f"doc_id long, text string, leaks {_LEAKS}")
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.similarity", "leak.first_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` into which no item leaks, with all columns (of any names), in one pass without a shuffle per group of items."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for items in item_groups(benchmark):
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def drop(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tc.release()
                row = batch.column(0)
                data, offsets = tc.text_buffer(row.field(row.type.get_field_index("text")))
                keep = np.ones(batch.num_rows, bool)
                for low, high in tc.slices(offsets):
                    found = find_leaks(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shared.value)
                    keep[[low + d for d, _ in found]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(drop, rows.schema)
    return rows.select("row.*")
