"""Vectorised text primitives used inside Arrow tasks: bytes, words, rolling hashes, shingles.

Arrow string columns are read as one byte buffer with offsets, so that no Python string is made for a
document. Long buffers are handled in slices of about ``SLICE`` bytes (always whole documents), which
keeps a task's memory independent of the batch size except for a single document longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Bytes of a slice whose arrays of 64-bit numbers stay in a core's cache, for steps of many passes over them.
CACHED = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def release() -> None:
    """Gives memory that Arrow has freed back to the system.

    A Python worker serves task after task; without this it holds the most that Arrow has taken in any of them. Tasks call it for every
    batch or group.
    """
    pa.default_memory_pool().release_unused()


def slices(offsets: np.ndarray, target: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``target`` bytes, at least one document each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + target, "right")) - 1)
        yield low, high
        low = high


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("power", ())) < n:
        size = max(n, SLICE + 65536)
        with np.errstate(over="ignore"):
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                _tables[name] = np.multiply.accumulate(out)
    return _tables["power"], _tables["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Prefix sums of a polynomial hash: ``ranges`` gives the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= self.power[:n]
        np.cumsum(values, out=self.prefix[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` bytes."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.prefix[size:] - self.prefix[:n]
        out *= self.inverse[:n]
        return mix(out)


def _byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return word, fold


#: ASCII white space only, as a byte can be tested without decoding.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Everything in ASCII but letters, digits and the underscore.
NON_WORD = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 95))
BY_SPACE = _byte_table(SPACE)
BY_WORD = _byte_table(NON_WORD)


@dataclass
class Words:
    """Words of some documents: byte ranges, hashes, and for each document its first word's index."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray] = BY_WORD) -> Words:
    """Maximal runs of word bytes, never across documents, with ASCII letters folded for the hash."""
    is_word, fold = table
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    start, end = at[:-1][keep], at[1:][keep]
    hashes = Rolling(fold[data]).ranges(start, end)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words inside each document, and each document's first run's index.

    A document with 1 to n-1 words has one run, of all its words; one without words has none.
    """
    total, counts = len(hashes), np.diff(first)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    left = np.repeat(first[1:], counts) - np.arange(total)  # words from here to the document's end
    out = np.zeros(total, np.uint64)
    for i in range(n):
        out += np.where(left > i, padded[i : i + total], np.uint64(0)) * seeds[i]
    runs = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    keep = (np.arange(total) - np.repeat(first[:-1], counts)) < np.repeat(runs, counts)
    return mix(out[keep]), begin


def grouped_order(group: np.ndarray, hashes: np.ndarray, groups: int) -> np.ndarray:
    """An order by group in which equal hashes of a group are neighbours.

    One sort of numbers that hold the group and all but the last bits of the hash; only where those bits alone tell two
    hashes apart, a sort by both.
    """
    bits = np.uint64(max(groups - 1, 1).bit_length())
    key = group.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits
    order = np.argsort(key)
    key = key[order]
    close = np.flatnonzero(key[1:] == key[:-1])
    if len(close) and (hashes[order[close]] != hashes[order[close + 1]]).any():
        return np.lexsort((hashes, group))
    return order


def weighted_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each document with their counts, documents in order."""
    if len(hashes) == 0:
        return hashes, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = grouped_order(doc, hashes, len(first) - 1)
    h = hashes[order]  # doc is in order already
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(first)))


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
