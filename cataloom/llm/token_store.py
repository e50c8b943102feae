"""A content-addressed store of token ids: chunks by rolling hash, recipes, and Merkle manifests.

Each document's ids (with the end id) are cut where a rolling hash of ``WINDOW`` ids hits a pattern, so equal passages
give equal chunks of about ``AVERAGE`` ids wherever they stand. The store is three Parquet tables in a folder:

* ``chunks`` (chunk_id, n, body): each distinct chunk once; body holds its ids as little-endian 16-bit
  numbers, or 32-bit ones where an id needs them; chunk_id is a 128-bit hash of the ids.
* ``recipes`` (doc_id, part, n_tokens, start, chunk_ids, sizes, root): in ascending doc_id order; start counts the ids
  of all earlier documents, root is the Merkle root of the document's chunk ids with their sizes, in order.
* ``manifest`` (part, documents, start, tokens, root): for each part its first start, its number of ids, and the Merkle root of its documents,
  each with doc_id, start, n_tokens and its own root.

Reading back checks every chunk against its id, every recipe against its root and its sizes, every part against the manifest, and that
each part begins where the one before it ends; a chunk that a recipe names and the store lacks, or holds in another size, is an error.
Then it gives per-document results from chunk contents: a document's CRC-32 is the sum of its chunks' CRC-32s, each moved along by
the bytes after it.

Defined results: null text is empty (the end id alone); rows without doc_id come first in order, repeated
rows each have their own place.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc
from cataloom.llm.exchange import partitions, record_batch
from cataloom.llm.scratch import Store, cut, tidy

WINDOW, AVERAGE, SMALLEST, LARGEST = 16, 256, 32, 4096
#: Pieces of text whose ids a task remembers, beyond which it starts afresh, and pieces that the library encodes at a time.
REMEMBERED, TOGETHER = 700_000, 4_096
#: Bytes of a piece that are compared as two numbers; longer ones are looked up as bytes.
SHORT = 16
_SPACE, _LETTER, _MARK, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """Of each byte: blank, ASCII letter, ASCII mark but no apostrophe, or anything else."""
    kind = np.full(256, _OTHER, np.uint8)
    for code in range(33, 127):
        char = chr(code)
        kind[code] = _LETTER if char.isalpha() else _OTHER if char.isdigit() or char == "'" else _MARK
    kind[[9, 10, 13, 32]] = _SPACE
    return kind


_KIND = _kinds()
_FOLD = tc._byte_table(b"")[1]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each piece of the texts, and where each text's pieces begin.

    Pieces end at white space, and between an ASCII letter and an ASCII mark other than an apostrophe: the tokenizer's
    own pre-tokens always end there, so the ids of pieces are the ids of the text.
    """
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    before, after = kind[:-1], kind[1:]
    edge[1:-1] = ((before == _SPACE) != (after == _SPACE)) | ((before ^ after) == (_LETTER ^ _MARK)) & (before != _SPACE) & (after != _SPACE)
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] != _SPACE
    start = at[:-1][keep]
    return start, at[1:][keep], np.searchsorted(start, offsets)


class WordTokenizer:
    """Ids by the tokenizers library, piece by piece; ids of equal pieces are remembered.

    Pieces of up to ``SHORT`` bytes are two numbers that hold just their bytes (letters lowered, as the tokenizer does);
    they are found by a hash of those and compared with the numbers themselves.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.hash, self.low, self.high, self.number = (np.zeros(0, k) for k in (np.uint64, np.uint64, np.uint64, np.int64))  # sorted by hash
        self.long: dict[bytes, int] = {}
        self.known, self.used = 0, 0
        self.first, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _learn(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, whose ids go behind those known."""
        words = [x.decode() for x in texts]
        plain = [i for i, x in enumerate(words) if x.isalpha() and max(x) < "\u0250" and "\u0130" not in x]
        other = sorted(set(range(len(words))) - set(plain))
        sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(other), TOGETHER):
            encoded = [e.ids for e in self.library.encode_batch_fast([words[at] for at in other[i : i + TOGETHER]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            found.append(np.fromiter(chain.from_iterable(encoded), np.uint32))
        for i in range(0, len(plain), TOGETHER):  # one pre-token each: in one text, each ends with a token that ends a word
            part = plain[i : i + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(words[at] for at in part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary has no word ends")
            sizes.append(np.diff(ends, prepend=0))
            found.append(ids)
        size, ids = np.concatenate(sizes), np.concatenate(found)
        while self.known + len(texts) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.known + 1 : self.known + 1 + len(texts)] = self.used + np.cumsum(size)
        numbers = np.empty(len(texts), np.int64)
        numbers[other + plain] = np.arange(self.known, self.known + len(texts))
        self.known, self.used = self.known + len(texts), self.used + len(ids)
        return numbers

    def _short(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of short pieces."""
        key = tc.mix(low + tc.mix(high + size.astype(np.uint64)))
        keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, keys)
        there = np.minimum(place, max(len(self.hash) - 1, 0))
        hit = self.hash[there] == keys if len(self.hash) else np.zeros(len(keys), bool)
        number = np.zeros(len(keys), np.int64)
        number[hit] = self.number[there[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            pair = np.stack([low[at[new]], high[at[new]]], 1).astype("<u8").tobytes()
            number[new] = self._learn([pair[SHORT * i : SHORT * i + n] for i, n in enumerate(size[at[new]].tolist())])
            self.hash, self.low, self.high, self.number = (np.insert(x, place[new], y) for x, y in ((self.hash, keys[new]), (self.low, low[at[new]]), (self.high, high[at[new]]), (self.number, number[new])))
        out = number[inverse]
        there = np.searchsorted(self.hash, keys)
        wrong = np.flatnonzero((self.low[there][inverse] != low) | (self.high[there][inverse] != high))
        for i in wrong.tolist():  # pieces with the hash of another piece
            out[i] = self._numbers([(int(low[i]) | int(high[i]) << 64).to_bytes(SHORT, "little")[: size[i]]])[0]
        return out

    def _numbers(self, found: list[bytes]) -> list[int]:
        """Numbers of pieces that are looked up as bytes; new ones are learned together."""
        new = [x for x in dict.fromkeys(found) if x not in self.long]
        for low, high in tc.slices(np.cumsum([0, *map(len, new)]), SHORT * TOGETHER):  # the library takes a hundred bytes a token: as much at a time as of short ones
            self.long.update(zip(new[low:high], self._learn(new[low:high]).tolist(), strict=True))
        return [self.long[x] for x in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer one after the other, and where each text's begin."""
        if self.known > REMEMBERED or self.used > 8 * REMEMBERED:
            self._reset()
        data = _FOLD[data]
        start, end, first = pieces(data, offsets)
        size = end - start
        short = size <= SHORT
        padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
        eight = np.ndarray((len(data) + SHORT,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        at, n = start[short], size[short]
        index = np.zeros(len(start), np.int64)
        index[short] = self._short(eight[at] & _MASKS[np.minimum(n, 8)], eight[at + 8] & _MASKS[np.maximum(n - 8, 0)], n)
        long = np.flatnonzero(~short)
        index[long] = self._numbers([data[a:b].tobytes() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        count = self.first[index + 1] - self.first[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(self.first[index] - ends[:-1], count) + np.arange(ends[-1])], ends[first]


#: The tokenizer of this Python process, which serves one task after another.
_tokenizers: dict[str, WordTokenizer] = {}


def cuts(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, in the ids of all: by content, at least SMALLEST and at most LARGEST ids.

    A window's hash does not depend on where it stands, so one pass over all documents finds the same ends as a pass over each.
    """
    hashes = tc.Rolling(ids).windows(WINDOW) if len(ids) >= WINDOW else np.zeros(0, np.uint64)
    at = np.flatnonzero(hashes % np.uint64(AVERAGE) == 0)
    low, high = np.searchsorted(at, first[:-1]).tolist(), np.searchsorted(at, first[1:] - WINDOW, "right").tolist()
    at, out = (at + WINDOW).tolist(), []
    for begin, n, a, b in zip(first[:-1].tolist(), first[1:].tolist(), low, high, strict=True):
        if n - begin <= SMALLEST + WINDOW:
            out.append([n])
            continue
        ends, last = [], begin
        for end in [*at[a:b], n]:
            while end - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if end - last >= SMALLEST or end == n and end > last:
                ends.append(end)
                last = end
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of hashes; of no leaves, the hash of nothing."""
    level = leaves or [b""]
    level = [hashlib.blake2b(x, digest_size=16, person=b"leaf").digest() for x in level]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() for i in range(0, len(level), 2)]
    return level[0]


def _recipe_root(names: list[bytes], sizes: list[int]) -> bytes:
    return merkle([name + size.to_bytes(4, "little") for name, size in zip(names, sizes, strict=True)])


def _chunks(ids: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """(n_tokens, chunk_ids, sizes, root, bodies) of each document of a buffer of ids."""
    wide, narrow = ids.astype("<u4"), None
    if ids.max(initial=0) < 65536:
        narrow = memoryview(ids.astype("<u2").tobytes())
    raw = memoryview(wide.tobytes())
    for begin, ends in zip(first[:-1].tolist(), cuts(ids, first), strict=True):
        begins = [begin, *ends[:-1]]
        parts = list(zip(begins, ends, strict=True))
        names = [hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in parts]
        sizes = [b - a for a, b in parts]
        # where all ids are narrow, so are those of each chunk
        bodies = [bytes(narrow[2 * a : 2 * b]) for a, b in parts] if narrow is not None else [wide[a:b].astype("<u2" if wide[a:b].max() < 65536 else "<u4").tobytes() for a, b in parts]
        yield ends[-1] - begin, names, sizes, _recipe_root(names, sizes), bodies


def _ids(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4")


def _encoded(batches: Iterator[pa.RecordBatch], definition: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the ids of all their texts, each with the end id, and where each text's begin."""
    if definition not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition] = WordTokenizer(definition)
    tokenizer = _tokenizers[definition]
    for batch in batches:
        tc.release()
        data, offsets = tc.text_buffer(batch.column("text"))
        for low, high in tc.slices(offsets, 2 << 20):
            ids, first = tokenizer.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            yield batch.slice(low, high - low), np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first))


def write(docs: DataFrame, store: Store, tokenizer_path: str, end_id: int = 1) -> None:
    """Writes ``docs`` (doc_id, text) as a store."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, n = docs.sparkSession, partitions(docs)
    with open(tokenizer_path) as file:  # part of an installed package, of about two megabytes
        shared = spark.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, first in _encoded(batches, shared.value, end_id):
            out = list(_chunks(ids, first))
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "n_tokens", "chunk_ids", "sizes", "root", "bodies"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[int, bytes]] = {}
            names, sizes, bodies = (batch.column(c).flatten().to_pylist() for c in ("chunk_ids", "sizes", "bodies"))
            for name, size, body in zip(names, sizes, bodies, strict=True):
                found.setdefault(name, (size, body))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int32()), pa.array([x[1] for x in found.values()], pa.binary())], ["chunk_id", "n", "body"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # rows come sorted by chunk_id
        for batch in batches:
            names = batch.column("chunk_id").to_pylist()
            keep = [name != before for name, before in zip(names, [last, *names[:-1]], strict=True)]
            last = names[-1] if names else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    with tidy(spark):
        # encoded once and written: placing the recipes in order samples its input first
        encoded = store.write(docs.mapInArrow(encode, "doc_id long, n_tokens long, chunk_ids array<binary>, sizes array<int>, root binary, bodies array<binary>"), "encoded")
        bodies = encoded.select("chunk_ids", "sizes", "bodies").mapInArrow(chunked, "chunk_id binary, n int, body binary").repartition(n, "chunk_id").sortWithinPartitions("chunk_id")
        store.write(bodies.mapInArrow(once, "chunk_id binary, n int, body binary"), "chunks")
        recipes = encoded.drop("bodies")
        placed = cut(recipes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id()))
        parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
        before = parts.withColumn("before", F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
        running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "root").rowsBetween(Window.unboundedPreceding, -1))
        joined = placed.join(F.broadcast(before.select("part", "before")), "part")
        recipes = joined.withColumn("start", F.coalesce("before", F.lit(0)) + F.coalesce(running, F.lit(0)))
        columns = ["doc_id", "part", "n_tokens", "start", "chunk_ids", "sizes", "root"]
        written = store.write(recipes.select(columns).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "root"), "recipes")
        store.write(_manifest(written), "manifest")
        store.drop("encoded")


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, documents, start, tokens, root) of each part; a part is a range of doc_id of bounded size."""

    def roots(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True))
        root = merkle([f"{doc}:{start}:{n}:".encode() + own for doc, start, n, own in rows])
        row = (table.column("part")[0].as_py(), len(rows), rows[0][1], sum(r[2] for r in rows), root)
        return pa.Table.from_batches([record_batch([row], ["part", "documents", "start", "tokens", "root"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])])

    return recipes.select("part", "doc_id", "start", "n_tokens", "root").groupBy("part").applyInArrow(roots, "part int, documents long, start long, tokens long, root binary")


_REFLECTED = 0xEDB88320


def _multiply(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, in its reflected bit order."""
    a, b = np.broadcast_to(np.asarray(a, np.uint64), b.shape), b.astype(np.uint64).copy()
    out = np.zeros(b.shape, np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(_REFLECTED), b >> np.uint64(1))
    return out


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32s moved along by ``after`` bytes, so that those of consecutive pieces add up (xor) to the whole's."""
    out, power = crc.astype(np.uint64), np.array([1 << 23], np.uint64)  # x to the 8th: one byte
    left = after.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _multiply(power[0], out[odd])
        power = _multiply(power[0], power)
        left >>= 1
    return out


def read(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, after checking them."""

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []  # bodies are small: a chunk has LARGEST ids at most
            for name, n, body in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "n", "body")), strict=True):
                raw = _ids(body, n).astype("<u4").tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("n"), pa.array(sums, pa.int64())], ["chunk_id", "n", "crc"])

    def check_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, own, root, n in zip(*(batch.column(c).to_pylist() for c in ("chunk_ids", "sizes", "root", "n_tokens")), strict=True):
                if len(names) != len(own) or not names or sum(own) != n or _recipe_root(names, own) != root:
                    raise ValueError("a recipe does not match its root")
            sizes = batch.column("sizes")
            first = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
            flat_sizes = sizes.flatten()
            flat = flat_sizes.to_numpy()
            through = np.cumsum(flat)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            after = 4 * (through[first[doc + 1] - 1] - through) if len(flat) else flat
            take = lambda c: batch.column(c).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([take("start"), pa.array(after, pa.int64()), batch.column("chunk_ids").flatten(), flat_sizes], ["start", "after", "chunk_id", "size"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = moved(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(out.astype(np.int64))], ["start", "crc"])

    recipes, manifest = store.read("recipes"), store.read("manifest")
    same = _manifest(recipes).join(manifest.toDF("part", "d", "s", "t", "r"), "part", "full")
    if not same.where("not (root <=> r and documents <=> d and start <=> s and tokens <=> t)").isEmpty():
        raise ValueError("the recipes do not match the manifest")
    follows = F.coalesce(F.lag(F.col("start") + F.col("tokens")).over(Window.orderBy("start", "part")), F.lit(0))  # a row a part
    if not manifest.where("documents > 0").select("start", follows.alias("end")).where("start <> end").isEmpty():
        raise ValueError("a part of the manifest is missing")
    sums = store.read("chunks").mapInArrow(open_chunks, "chunk_id binary, n int, crc long")
    pieces = recipes.select("start", "n_tokens", "chunk_ids", "sizes", "root").mapInArrow(check_roots, "start long, after long, chunk_id binary, size int")
    there = F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("the store lacks chunk "), F.hex("chunk_id"))).cast("long"))
    found = pieces.join(sums, "chunk_id", "left").select("start", "after", there.alias("crc")).mapInArrow(shift, "start long, crc long")
    whole = found.groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"))  # no two documents share a start
    out = recipes.select("doc_id", "start", "n_tokens").join(whole, "start", "left")
    crc = F.coalesce("ids_crc32", F.raise_error(F.lit("a document has no chunks")).cast("long"))
    return out.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def through_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes ``docs`` as a store in the shared folder and reads it back."""
    store = Store(docs.sparkSession, "tokens")
    write(docs, store, tokenizer_path, end_id)
    with tidy(docs.sparkSession):
        out = cut(read(store))
    for name in ("chunks", "recipes", "manifest"):
        store.drop(name)
    return out
