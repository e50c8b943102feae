"""Removal of repeated lines, exact and fuzzy, across all documents.

A line's set of ``CHARS``-character shingles gets a one-permutation MinHash signature (one hash per shingle,
``PLACES`` bins, empty bins filled from others by a fixed random order). Lines sharing one of ``BANDS`` bands of
the signature are candidates, an exact Jaccard similarity of at least 0.8 links them, and distributed
union-find keeps the first line (by doc_id, then place) of each component.

Which bands at least two lines share is found by exchanging packed band hashes of a block's distinct lines between blocks of documents and
buckets (see exchange.py). With a hash go the line's number in its block and its checksum (CRC-32): the answer names the lines, so that only those are
signed again, and tells copies of one line, which need no comparison, from different lines, which alone are shuffled with their text.

Lines end at a line feed; white space around a line does not count. A line of fewer than ``CHARS`` characters is one shingle as a
whole, so it goes where it is an exact repeat; empty lines are left alone. Defined results: null text stays null; a document may lose all lines and is
then empty; rows of equal doc_id count as one document; rows without doc_id are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc
from cataloom.llm.exchange import KEY_BITS, block_by_hash, layout, pack_keys, record_batch, shorten, told, unpack_keys
from cataloom.llm.near_classes import near_classes, pack_signatures
from cataloom.llm.scratch import Scratch, cut, tidy

CHARS, SIMILARITY, BANDS, ROWS = 6, 0.8, 12, 5
#: Characters of the shortest line that counts.
SHORTEST = 1
PLACES = BANDS * ROWS
AGREE = 0.5
#: Lines of a block whose ranges are Python numbers at a time.
TURN = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 13, 32]] = True


def _fill_order() -> np.ndarray:
    """For each bin the bins to borrow from, in order."""
    rng = np.random.Generator(np.random.PCG64(5))
    return np.stack([rng.permutation(PLACES) for _ in range(PLACES)])


_FILL = _fill_order()


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets in them; bytes that are not UTF-8 count as they are."""
    if not len(data) or data.max() < 128:
        return data, offsets
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data.astype(np.uint32), offsets
    if len(points) == len(data):
        return points, offsets
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[offsets]


def shingles(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each range of code points (none empty), and where each range's begin; a short range is one shingle."""
    rolling, short = tc.Rolling(points), end - start < CHARS
    windows = rolling.windows(CHARS)
    size = np.where(short, 1, end - start - CHARS + 1)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - first[:-1], size) + np.arange(first[-1])
    out = windows.take(at, mode="clip") if len(windows) else np.zeros(len(at), np.uint64)
    out[first[:-1][short]] = tc.mix(rolling.ranges(start[short], end[short]) ^ (end - start)[short].astype(np.uint64))
    return out, first


def sign(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, PLACES) uint32 signatures."""
    n = len(first) - 1
    bins = ((hashes >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)).astype(np.int64)
    flat = np.full(n * PLACES, 1 << 32, np.int64)
    np.minimum.at(flat, np.repeat(np.arange(n) * PLACES, np.diff(first)) + bins, (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    empty = flat == 1 << 32
    at = np.flatnonzero(empty)
    place = at % PLACES
    for turn in range(PLACES):
        if not len(at):
            break
        source = at - place + _FILL[:, turn].take(place)
        good = ~empty.take(source)
        flat[at[good]] = flat.take(source[good])
        at, place = at[~good], place[~good]
    return flat.reshape(n, PLACES).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) uint64."""
    seeds = tc.mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
    return tc.mix((tc.mix(sig.astype(np.uint64)) * seeds).reshape(len(sig), BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=np.uint64))


def _stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges without outer white space; where nothing else is in them, empty."""
    start, end = start.copy(), end.copy()
    for _ in range(4):
        blank = np.flatnonzero(start < end)
        blank = blank[_SPACE[data[start[blank]]]]
        start[blank] += 1
        last = np.flatnonzero(start < end)
        last = last[_SPACE[data[end[last] - 1]]]
        end[last] -= 1
        if not len(blank) and not len(last):
            return start, end
    some = np.flatnonzero(start < end)
    for n in some[_SPACE[data[start[some]]] | _SPACE[data[end[some] - 1]]].tolist():  # long runs of white space
        ink = np.flatnonzero(~_SPACE[data[start[n] : end[n]]])
        end[n] = start[n] + (ink[-1] + 1 if len(ink) else 0)
        start[n] += ink[0] if len(ink) else 0
    return start, end


class Lines:
    """Lines of the documents of a block: byte ranges without outer white space, places, and which of them say the same.

    ``texts`` are the distinct lines that are long enough, in byte order, so that their numbers do not depend on the order of a block's rows;
    ``number`` is that of each line (-1: too short).
    """

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = tc.text_buffer(table.column("text"))
        data, offsets = self.data, self.offsets
        breaks = np.flatnonzero(data == 10)
        doc = np.searchsorted(offsets, breaks, "right") - 1
        start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.doc = np.sort(np.concatenate([np.arange(len(self.ids)), doc]), kind="stable")
        end = np.concatenate([start[1:] - (self.doc[1:] == self.doc[:-1]), offsets[-1:]]) if len(start) else start
        self.place = np.arange(len(start)) - np.searchsorted(self.doc, self.doc)
        self.start, self.end = _stripped(data, start, end)
        self.texts, self.number = self._distinct()

    def _distinct(self) -> tuple[list[bytes], np.ndarray]:
        raw, met, number = self.data.tobytes(), {}, np.full(len(self.start), -1, np.int64)
        some = np.flatnonzero(self.end - self.start >= SHORTEST)
        for low in range(0, len(some), TURN):
            lines = some[low : low + TURN]
            ranges = zip(self.start[lines].tolist(), self.end[lines].tolist(), strict=True)
            number[lines] = np.fromiter((met.setdefault(raw[s:e], len(met)) for s, e in ranges), np.int64, len(lines))
        long = [x for x in met if len(x) >= 4 * SHORTEST or len(x.decode("utf-8", "replace")) >= SHORTEST]
        place = np.full(len(met) + 1, -1)  # its last entry is that of short lines
        texts = sorted(long)
        place[np.fromiter((met[x] for x in texts), np.int64, len(texts))] = np.arange(len(texts))
        return texts, place[number]


def signed(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Signatures of lines, in slices."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    for low, high in tc.slices(ends, tc.CACHED):
        part = np.frombuffer(b"".join(texts[low:high]), np.uint8)
        points, bounds = characters(part, ends[low : high + 1] - ends[low])
        yield sign(*shingles(points, bounds[:-1], bounds[1:]))


def _ask(buckets: int):
    """For each bucket the bands of a block's distinct lines: keys, and of what line each is, by its checksum and its number."""

    def ask(table: pa.Table) -> pa.Table:
        names = ["block", "bucket", "high", "low", "sum", "line"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        tc.release()
        texts, rows = Lines(table).texts, []
        if texts:
            keys = np.concatenate([shorten(band_hashes(sig), buckets).ravel() for sig in signed(texts)])
            order = np.argsort(keys)
            keys, line = keys[order], (order // BANDS).astype(np.uint32)
            sums = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))[line]
            block = table.column("block")[0].as_py()
            rows = [(block, bucket, *pack_keys(keys[part], buckets), sums[part].tobytes(), line[part].tobytes()) for bucket, part in told(keys, buckets)]
        return pa.Table.from_batches([record_batch(rows, names, kinds)])

    return ask


_TOLD = "block long, bucket int, again binary, near binary, keys binary"


def _answer(table: pa.Table) -> pa.Table:
    """For each block its lines of which a band came again, and those, with the band's key, that share it with a line of another checksum."""
    tc.release()
    bucket = table.column("bucket")[0].as_py()
    parts = [unpack_keys(h, b) for h, b in zip(table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True)]
    sums, line = (np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("sum", "line"))
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    again = np.repeat(size > 1, size)
    near = np.repeat(np.minimum.reduceat(sums, first) != np.maximum.reduceat(sums, first), size)
    order, keys, near = order[again], keys[again], near[again]
    line, part = line[order], part[order]
    by = np.argsort(part, kind="stable")
    line, keys, near, edges = line[by], keys[by] | np.uint64(bucket << KEY_BITS), near[by], np.searchsorted(part[by], np.arange(len(parts) + 1))
    rows = []
    for n, block in enumerate(table.column("block").to_pylist()):
        own = slice(edges[n], edges[n + 1])
        if own.stop > own.start:
            close = near[own]
            rows.append((block, bucket, np.unique(line[own]).tobytes(), line[own][close].tobytes(), keys[own][close].tobytes()))
    return pa.Table.from_batches([record_batch(rows, ["block", "bucket", "again", "near", "keys"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])])


def _candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Every line that shares a band; the first of equal lines of a block brings its signature, bands shared with others, and text."""
    names = ["doc_id", "place", "key", "sig", "buckets", "line"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    tc.release()
    if not len(table):
        return pa.Table.from_batches([record_batch([], names, kinds)])
    lines = Lines(table)
    texts = lines.texts
    again, near, keys = (np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("again", np.uint32), ("near", np.uint32), ("keys", np.int64)))
    order = np.argsort(near, kind="stable")
    chosen, first = np.unique(near[order], return_index=True)
    bands = np.split(keys[order], first[1:]) if len(chosen) else []
    sig = [x.tobytes() for part in signed([texts[n] for n in chosen.tolist()]) for x in pack_signatures(part)]
    told_of = np.bincount(lines.number[lines.number >= 0], minlength=len(texts)) > 1  # some lines come again in the block only
    told_of[again] = True
    at = np.flatnonzero(np.append(told_of, False)[lines.number])
    _, index = np.unique(lines.number[at], return_index=True)
    brings = np.zeros(len(at), bool)
    brings[index] = True
    digest = {n: hashlib.md5(texts[n]).digest() for n in np.flatnonzero(told_of).tolist()}
    known = {n: k for k, n in enumerate(chosen.tolist())}
    number = lines.number[at].tolist()
    with_it = [known.get(n) if b else None for n, b in zip(number, brings.tolist(), strict=True)]
    columns = [
        lines.ids[lines.doc[at]],
        lines.place[at],
        [digest[n] for n in number],
        [None if k is None else sig[k] for k in with_it],
        [None if k is None else bands[k] for k in with_it],
        [None if k is None else texts[n].decode("utf-8", "replace") for n, k in zip(number, with_it, strict=True)],
    ]
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def read_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each line, all of weight 1."""
    points, bounds = characters(*tc.text_buffer(column))
    keys, _, first = tc.weighted_sets(*shingles(points, bounds[:-1], bounds[1:]))
    return keys, np.ones(len(keys)), first


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): for each document that loses lines, the places of those lines from 0."""
    blocks, buckets = layout(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    dealt = docs.select(block_by_hash(blocks, F.col("doc_id")).alias("block"), "*").repartition(buckets, "block")
    with tidy(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        asked = dealt.groupBy("block").applyInArrow(_ask(buckets), "block long, bucket int, high binary, low binary, sum binary, line binary")
        answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, _TOLD)
        found = scratch.cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_candidates, "doc_id long, place int, key binary, sig binary, buckets array<long>, line string"))
        items = scratch.cut(found.where("sig is not null").select(F.col("key").alias("id"), "sig", "buckets", "line").repartition("id").dropDuplicates(["id"]))  # dealt first: a block has a line once, so nothing merges before
        texts = items.select("id", F.col("line").alias("body"))
        groups = near_classes(scratch, items.select("id", "sig", "buckets"), lambda ids: texts.join(ids, "id", "left_semi"), AGREE, read_lines, SIMILARITY, shared=True)
        lines = found.select("doc_id", "place", "key").join(groups.withColumnRenamed("node", "key"), "key", "left")
        lines = lines.select("doc_id", "place", F.coalesce("component", "key").alias("class"))
        # written, so that both sides of the join are dealt anew and a class that very many documents have can be split
        lines = scratch.cut(lines)
        first = scratch.cut(lines.groupBy("class").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first"))
        gone = lines.join(first, "class").where(F.struct("doc_id", "place") != F.col("first"))
        return cut(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("gone")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, repeated lines taken out of text; also __lines and __gone, the lines before and taken out.

    The columns travel as one struct, so that their names meet none of those used here (__lines and __gone are replaced).
    """
    gone = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__places"))
    names = [c for c in docs.columns if c not in ("__lines", "__gone")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("doc_id").cast("long").alias("__doc"))
    joined = packed.join(gone.hint("shuffle_hash"), F.col("__doc") == F.col("__id"), "left")  # places are few: the texts are not sorted to meet them
    text = F.col("__row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__places", i)), "\n")
    kept = F.when(F.col("__places").isNull(), text).otherwise(kept)
    columns = [kept.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in names]
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))  # without making the lines
    gone = F.when(text.isNull() | F.col("__places").isNull(), 0).otherwise(F.size("__places"))
    return joined.select(*columns, F.coalesce(breaks + 1, F.lit(0)).alias("__lines"), gone.alias("__gone"))
