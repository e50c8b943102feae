"""Removal of long passages that an earlier document has, with a logarithmic family of suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller doc_id goes;
all strings are judged on the input. Documents form blocks in doc_id order, and each block is one new batch:

1. Suffixes are sampled where equal strings must agree: the least 25-byte hash of a 50-byte window is the same
   wherever that window occurs. A block sends its distinct sampled hashes, and learns which of them
   more than one document has. Everything else cannot repeat and is not looked at again.
2. For the rest a block sends the bytes around the sampled suffixes. A bucket takes its batches in order of
   doc_id: it makes a suffix array of each (suffixes in byte order by their first 50 bytes), merge-scans it against the existing
   levels, all of smaller doc_id, and adds what none of them has as a level; levels of like size merge geometrically.
   One bit per suffix goes back to the block.

Hashes only bring equal strings together; bytes are compared before anything goes. A sample that more than ``HOT`` blocks have
stands for many different surroundings, so its windows are dealt over all buckets by their own hash, one by one.

Defined results: null text is empty; rows of equal doc_id do not remove from each other; rows without doc_id
are returned whole and remove nothing; doc_ids may be sparse, negative or random.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cataloom.llm import textcore as tc
from cataloom.llm.exchange import layout, pack_keys, range_bounds, record_batch, shorten, told, unpack, unpack_keys
from cataloom.llm.scratch import cut, tidy

LENGTH, SAMPLE, HOT = 50, 25, 128
_WINDOWS = LENGTH - SAMPLE + 1  # windows that one sampled suffix can stand for
_CONTEXT = LENGTH + _WINDOWS - 1
_LAST = np.iinfo(np.int64).max
#: For each number of windows, 1 for the bytes that they have.
_UPTO = (np.arange(_CONTEXT) < np.arange(_WINDOWS + 1)[:, None] + LENGTH - 1).astype(np.uint8)
#: Surroundings that a bucket sorts as one batch; blocks are taken together up to this many.
BATCH = 1 << 15
#: Places of the eight-byte words by which two windows are compared.
_WORDS = (0, 8, 16, 24, 32, 40, LENGTH - 8)


class Suffixes:
    """Segments of consecutive windows with the same sampled hash, for the documents of one block."""

    def __init__(self, table: pa.Table, buckets: int):
        table = table.sort_by([("doc_id", "ascending")])
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = tc.text_buffer(table.column("text"))
        self.buckets = buckets
        parts = [self._segments(low, high) for low, high in tc.slices(self.offsets, tc.CACHED)]
        self.sample, self.text, self.doc, self.start, self.count = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys, self.inverse = np.unique(self.sample, return_inverse=True)

    def _segments(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        base = self.offsets[low]
        data, offsets = self.data[base : self.offsets[high]], self.offsets[low : high + 1] - base
        sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        if not sizes.any():
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none
        rolling = tc.Rolling(data)
        least = rolling.windows(SAMPLE)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: len(least) - 10], least[10:])
        # a segment ends where the minimum changes, where a document begins, and behind a document's last window
        edge = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=edge[1:-1])
        edge[offsets[:-1][offsets[:-1] < len(least)]] = True
        behind = offsets[:-1] + sizes
        edge[behind[behind < len(least)]] = True
        at = np.flatnonzero(edge)
        at, length = at[:-1], np.diff(at)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at < behind[doc]
        at, length, doc = at[inside], length[inside], doc[inside]
        parts = -(-length // _WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(at, parts) + nth * _WINDOWS, np.minimum(np.repeat(length, parts) - nth * _WINDOWS, _WINDOWS)
        text = rolling.ranges(start, start + count + LENGTH - 1)
        # minima are small numbers: spread them again
        return shorten(tc.mix(least[start]), self.buckets), text, np.repeat(doc, parts) + low, start + base, count

    def several(self) -> np.ndarray:
        """Whether several documents of the block have each of the distinct samples."""
        low, high = np.full(len(self.keys), _LAST), np.full(len(self.keys), -_LAST)
        np.minimum.at(low, self.inverse, self.ids[self.doc])
        np.maximum.at(high, self.inverse, self.ids[self.doc])
        return low < high

    def units(self, answers: np.ndarray) -> Units:
        """What is sent for samples that repeat (answer 1: whole segments) or are hot (answer 2: their windows)."""
        answer = answers[self.inverse]
        at = np.flatnonzero(answer)
        return Units(self.sample[at], self.text[at], self.ids[self.doc[at]], self.start[at], self.count[at], self._surroundings(self.start[at], self.count[at]), answer[at] == 2)

    def _surroundings(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The bytes of ``count`` windows from ``start`` on, zeros behind them."""
        padded = np.concatenate([self.data, np.zeros(_CONTEXT, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, _CONTEXT)[start]
        out *= _UPTO[count]
        return out


class Units:
    """Segments, equal ones together, and what is sent for the distinct ones, in order of its keys: whole, or where they are hot each window once."""

    def __init__(self, key: np.ndarray, text: np.ndarray, owner: np.ndarray, start: np.ndarray, count: np.ndarray, context: np.ndarray, hot: np.ndarray):
        order = np.lexsort((owner, text, key))
        self.start, self.owner, self.count = start[order], owner[order], count[order]
        key, context, hot = key[order], context[order], hot[order]
        first = np.flatnonzero(_differs(key, self.count, context))
        self.index = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.least = np.minimum.reduceat(self.owner, first) if len(first) else self.owner[:0]
        key, context, count, hot = key[first], context[first], self.count[first], hot[first]
        # each window of a hot unit: the unit, and its place in it
        n = np.where(hot, count, 0)
        unit = np.repeat(np.arange(len(first)), n)
        offset = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        window = np.zeros((len(unit), _CONTEXT), np.uint8)
        window[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(context, LENGTH, 1)[unit, offset] if len(unit) else 0
        own = tc.mix(_digest(window))
        cold = np.flatnonzero(~hot)
        self.unit, self.offset = np.concatenate([cold, unit]), np.concatenate([np.zeros(len(cold), np.int64), offset])
        key, context = np.concatenate([key[cold], own]), np.concatenate([context[cold], window])
        windows, least = np.concatenate([count[cold], np.ones(len(unit), np.int64)]), self.least[self.unit]
        order = np.lexsort((least, windows, key))
        first = np.flatnonzero(_differs(key[order], windows[order], context[order]))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        chosen = order[first]
        self.key, self.context, self.windows, self.first = key[chosen], context[chosen], windows[chosen], least[chosen]

    def seen(self, bits: np.ndarray) -> np.ndarray:
        """For each distinct segment a bit for each window that a smaller document has, from the bits of what was sent."""
        told = bits[self.entry] | (self.first[self.entry] < self.least[self.unit])  # of equal windows, another unit's document may be smaller
        out = np.zeros(len(self.least), np.uint32)
        np.bitwise_or.at(out, self.unit, told << self.offset.astype(np.uint32))
        return out


def _differs(key: np.ndarray, count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before, by all their bytes."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (count[1:] != count[:-1])
    same = np.flatnonzero(~new)
    new[same] = (context[same] != context[same - 1]).any(1)
    return new


def _digest(context: np.ndarray) -> np.ndarray:
    """A hash of the rows of ``context``."""
    padded = np.zeros((len(context), -(-_CONTEXT // 8) * 8), np.uint8)
    padded[:, :_CONTEXT] = context
    words = padded.view(np.uint64)
    out = np.zeros(len(context), np.uint64)
    for column in range(words.shape[1]):
        out = tc.mix(out + words[:, column])
    return out


def suffix_words(context: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, words) of all windows of some contexts, in whose order their bytes stand, and the context of each."""
    padded = np.zeros((len(context), _CONTEXT + 8), np.uint8)
    padded[:, :_CONTEXT] = context
    owner = np.repeat(np.arange(len(context)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = np.ndarray((max(padded.size - 7, 0),), ">u8", padded, strides=(1,))  # the eight bytes from each place on
    begin = owner * padded.shape[1] + offset
    words = np.empty((len(owner), len(_WORDS)), np.uint64)
    for column, place in enumerate(_WORDS):
        words[:, column] = flat[begin + place]
    return words, owner


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The suffix array: an order of the rows by all their words; the later words are sorted only where the first is shared."""
    order = np.argsort(words[:, 0])
    first = words[order, 0]
    same = first[1:] == first[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(shared)
    if len(at):
        rows = order[at]
        order[at] = rows[np.lexsort((*words.take(rows, 0).T[:0:-1], first[at]))]
    return order


class Contexts:
    """Surroundings that a bucket has had. All their windows are in its levels, so what comes again need not be sorted."""

    def __init__(self):
        self.digest, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.context, self.windows = np.zeros((0, _CONTEXT), np.uint8), np.zeros(0, np.int64)

    def known(self, digest: np.ndarray, context: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Whether each was there before, by all its bytes."""
        out, at = np.zeros(len(digest), bool), np.searchsorted(self.digest, digest)
        hit = np.flatnonzero(at < len(self.digest))
        hit = hit[self.digest[at[hit]] == digest[hit]]
        place = self.place[at[hit]]
        out[hit] = (self.windows[place] == windows[hit]) & (self.context.take(place, 0) == context.take(hit, 0)).all(1)
        return out

    def add(self, digest: np.ndarray, context: np.ndarray, windows: np.ndarray) -> None:
        digest, place = np.concatenate([self.digest, digest]), np.concatenate([self.place, len(self.windows) + np.arange(len(digest))])
        order = np.argsort(digest)
        self.digest, self.place = digest[order], place[order]
        self.context, self.windows = np.concatenate([self.context, context]), np.concatenate([self.windows, windows])


class SuffixLevels:
    """Suffix arrays with the least document of each suffix; no two hold the same one, and like sizes are merged."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, words: np.ndarray) -> np.ndarray:
        """Least document of each of the sorted suffixes in any level, _LAST where it is in none."""
        out = np.full(len(words), _LAST)
        for level, least in self.levels:
            at, there = _places(level, words)
            out[there] = least[at[there]]
        return out

    def add(self, words: np.ndarray, least: np.ndarray) -> None:
        """A new level of sorted suffixes that no level holds."""
        if not len(words):
            return
        self.levels.append((words, least))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (new, new_least), (old, old_least) = self.levels.pop(), self.levels.pop()
            at, _ = _places(old, new)
            self.levels.append((np.insert(old, at, new, axis=0), np.insert(old_least, at, new_least)))


def _places(level: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the place of the first of ``level`` that is not before it, and whether that is its equal.

    The first words are merged at once; where a level has several suffixes of that word, the rest is found by bisection.
    """
    keys = np.ascontiguousarray(level[:, 0])
    low, there = np.searchsorted(keys, words[:, 0]), np.zeros(len(words), bool)
    open_ = np.flatnonzero(low < len(keys))
    open_ = open_[keys[low[open_]] == words[open_, 0]]
    there[open_] = (level.take(low[open_], 0) == words.take(open_, 0)).all(1)
    open_ = open_[~there[open_]]
    a, high = low[open_], np.searchsorted(keys, words[open_, 0], "right")
    b = high.copy()
    while len(going := np.flatnonzero(a < b)):
        middle = (a[going] + b[going]) // 2
        less = _less(level.take(middle, 0), words.take(open_[going], 0))
        a[going] = np.where(less, middle + 1, a[going])
        b[going] = np.where(less, b[going], middle)
    low[open_] = a
    inside = np.flatnonzero(a < high)
    there[open_[inside]] = (level[a[inside]] == words[open_[inside]]).all(1)
    return low, there


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differs = a != b
    at = differs.argmax(1)
    rows = np.arange(len(a))
    return differs.any(1) & (a[rows, at] < b[rows, at])


def _ask_samples(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        suffixes = Suffixes(table, buckets)
        several, block = suffixes.several(), table.column("block")[0].as_py()
        rows = [(block, bucket, *pack_keys(suffixes.keys[part], buckets), np.packbits(several[part]).tobytes()) for bucket, part in told(suffixes.keys, buckets)]
        return pa.Table.from_batches([record_batch(rows, ["block", "bucket", "high", "low", "several"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])])

    return ask


def _answer_samples(table: pa.Table) -> pa.Table:
    """0 for a sample of one document, 1 where several have it, 2 where more than HOT blocks do."""
    parts = [unpack_keys(h, b) for h, b in zip(table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True)]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table.column("several").to_pylist(), parts, strict=True)]
    _, index = np.unique(np.concatenate(parts), return_inverse=True)
    blocks = np.bincount(index)
    answer = ((blocks > 1) | (np.bincount(index, np.concatenate(several)) > 0)).astype(np.uint8) + (blocks > HOT)
    answer, ends, bucket = answer[index], np.cumsum([len(p) for p in parts]), table.column("bucket")[0].as_py()
    rows = [(b, 1, bucket, answer[e - len(p) : e].tobytes()) for b, p, e in zip(table.column("block").to_pylist(), parts, ends, strict=True)]
    return _answers(rows)


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([record_batch(rows, ["block", "phase", "bucket", "body"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])])


def _told(answers: pa.Table, phase: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Answers of one phase in the order of the sorted keys that were asked for."""
    found = {b: x for p, b, x in zip(answers.column("phase").to_pylist(), answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True) if p == phase}
    kind = np.uint8 if phase == 1 else np.uint32
    parts = [np.frombuffer(found[bucket], kind) for bucket, _ in told(keys, buckets)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _ask_surroundings(buckets: int):
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = ["block", "bucket", "context", "windows", "doc"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        rows = []
        if len(table):
            suffixes = Suffixes(table, buckets)
            units, block = suffixes.units(_told(answers, 1, suffixes.keys, buckets)), table.column("block")[0].as_py()
            rows = [(block, bucket, units.context[part].tobytes(), units.windows[part].astype(np.uint8).tobytes(), units.first[part].tobytes()) for bucket, part in told(units.key, buckets)]
        return pa.Table.from_batches([record_batch(rows, names, kinds)])

    return ask


def _batches(table: pa.Table):
    """Rows of a bucket in order of their blocks, some at a time: places of the rows, contexts, windows and documents."""
    rows, size = [], 0
    windows = [unpack(x, np.uint8) for x in table.column("windows").to_pylist()]
    for n in np.argsort(table.column("block").to_numpy(), kind="stable").tolist():
        rows.append(n)
        size += len(windows[n])
        if size >= BATCH:
            yield rows, *_unpacked(table, rows, windows)
            rows, size = [], 0
    if rows:
        yield rows, *_unpacked(table, rows, windows)


def _unpacked(table: pa.Table, rows: list[int], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context = np.concatenate([unpack(table.column("context")[n].as_py(), np.uint8) for n in rows]).reshape(-1, _CONTEXT)
    return context, np.concatenate([windows[n] for n in rows]).astype(np.int64), np.concatenate([unpack(table.column("doc")[n].as_py(), np.int64) for n in rows])


def _answer_surroundings(table: pa.Table) -> pa.Table:
    levels, had, out, bucket = SuffixLevels(), Contexts(), [], table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    for rows, context, windows, doc in _batches(table):
        digest = _digest(context)
        order = np.lexsort((doc, windows, digest))
        sorted_ = context.take(order, 0)
        new = np.ones(len(order), bool)
        new[1:] = (windows[order[1:]] != windows[order[:-1]]) | (sorted_[1:] != sorted_[:-1]).any(1)
        first = np.flatnonzero(new)
        least, chosen = np.minimum.reduceat(doc[order], first), order[first]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        # a batch before this one has smaller documents only: of surroundings that it had, every window has been seen
        distinct = digest[chosen], sorted_.take(first, 0), windows[chosen]
        old = had.known(*distinct)
        fresh = np.flatnonzero(~old)
        distinct = tuple(x.take(fresh, 0) for x in distinct)
        had.add(*distinct)
        words, owner = suffix_words(*distinct[1:])
        array = suffix_order(words)
        words, owner = words.take(array, 0), owner[array]
        head = np.ones(len(words), bool)
        head[1:] = words[1:, 0] != words[:-1, 0]
        tied = np.flatnonzero(~head)
        head[tied] = (words.take(tied, 0) != words.take(tied - 1, 0)).any(1)
        at = np.flatnonzero(head)
        heads = words.take(at, 0)
        inside, before = np.minimum.reduceat(least[fresh][owner], at) if len(at) else np.zeros(0, np.int64), levels.scan(heads)
        unseen = before == _LAST
        levels.add(heads[unseen], inside[unseen])
        earliest = np.empty(len(array), np.int64)
        earliest[array] = np.minimum(inside, before)[np.cumsum(head) - 1]
        # back to the contexts as they came: a bit for each window that a smaller document has
        begin = np.zeros(len(old), np.int64)
        begin[fresh] = np.cumsum(distinct[2]) - distinct[2]
        seen = ((np.int64(1) << windows) - 1).astype(np.uint32)
        asked = np.flatnonzero(~old[which])
        seen[asked] = 0
        for offset in range(_WINDOWS):
            asked = asked[windows[asked] > offset]
            seen[asked] |= (earliest[begin[which[asked]] + offset] < doc[asked]).astype(np.uint32) << np.uint32(offset)
        ends = np.cumsum([len(table.column("windows")[n].as_py()) for n in rows])
        out += [(blocks[n], 2, bucket, part.tobytes()) for n, part in zip(rows, np.split(seen, ends[:-1]), strict=True)]
    return _answers(out)


def _remove(buckets: int, texts: bool):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        if not len(table):
            return pa.Table.from_batches([record_batch([], names, kinds)])
        suffixes = Suffixes(table, buckets)
        units = suffixes.units(_told(answers, 1, suffixes.keys, buckets))
        bits = units.seen(_told(answers, 2, units.key, buckets))[units.index]
        later = units.owner > units.least[units.index]
        offset = np.arange(_WINDOWS)
        flagged = (later[:, None] | ((bits[:, None] >> offset.astype(np.uint32)) & 1).astype(bool)) & (offset < units.count[:, None])
        starts, n = (units.start[:, None] + offset)[flagged], len(suffixes.data) + 1
        gone = np.cumsum(np.bincount(starts, minlength=n)[:n] - np.bincount(starts + LENGTH, minlength=n)[:n])[:-1] > 0
        rows = []
        for n, doc in enumerate(suffixes.ids.tolist()):
            part = slice(suffixes.offsets[n], suffixes.offsets[n + 1])
            mine = gone[part]
            kept = suffixes.data[part][~mine].tobytes()
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if len(mine) else 0
            rows.append((doc, len(mine), int(mine.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        return pa.Table.from_batches([record_batch(rows, names, kinds)])

    return remove


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept, the remaining bytes, only with ``texts``."""
    spark = docs.sparkSession
    blocks, buckets = layout(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    bounds = spark.sparkContext.broadcast(range_bounds(known, blocks))  # a number per block

    @F.pandas_udf(LongType())
    def block_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, doc_id.to_numpy()))

    placed = known.select(block_of("doc_id").alias("block"), "doc_id", "text").repartition(buckets, "block")
    with tidy(spark):
        asked = placed.groupBy("block").applyInArrow(_ask_samples(buckets), "block long, bucket int, high binary, low binary, several binary")
        first = cut(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer_samples, "block long, phase int, bucket int, body binary"))
        more = placed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_ask_surroundings(buckets), "block long, bucket int, context binary, windows binary, doc binary")
        seen = cut(more.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer_surroundings, "block long, phase int, bucket int, body binary"))
    out = placed.groupBy("block").cogroup(first.union(seen).groupBy("block")).applyInArrow(_remove(buckets, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    body = F.col("text").cast("binary")
    rest = docs.where("doc_id is null").select("doc_id", F.length(body).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(body, 256), body)
    return out.union(rest) if texts else out.union(rest).drop("kept")
