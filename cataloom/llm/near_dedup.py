"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

A document is the weighted set of its five-word shingles, weight = count x idf. Documents with the same
bytes form one exact class first. One document of each class gets ``BANDS x ROWS`` consistent weighted
samples; classes that share a band are compared, and linked where the weighted Jaccard similarity of their
whole shingle sets is at least 0.8 (see near_classes.py). Components of links are the near-duplicate classes.

Document frequencies are counted exactly over all documents by the exchange of packed keys (see exchange.py);
idf = 1 + ln((N+1)/(df+1)) / ln(N+2), between 1 and 2, so that wide-spread shingles count for less but no edit of a
few words outweighs a shared page.

Defined results: null text is empty text; texts without a word are compared by bytes alone; texts of 1 to 4
words have one shingle; rows without doc_id count for the frequencies and are returned with null class; repeated
rows share a class; texts of one doc_id are classed each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc
from cataloom.llm.exchange import block_by_hash, layout, pack_keys, record_batch, shorten, told, unpack, unpack_keys
from cataloom.llm.near_classes import near_classes, pack_signatures
from cataloom.llm.scratch import Scratch, cut, tidy

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 5
PLACES = BANDS * ROWS
#: A pair whose samples agree in fewer places than this share is not compared: at similarity 0.8 the chance of that is about 1e-4.
AGREE = 0.6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, buckets: int = 1):
    """Distinct shingles and counts of the documents of a buffer, and where each document's begin."""
    found = tc.words(data, offsets)
    hashes, first = tc.ngrams(found.hash, found.first, SHINGLE)
    return tc.weighted_sets(shorten(hashes, buckets), first)


def _slices(table: pa.Table, buckets: int) -> Iterator[tuple]:
    """Document ranges of a block with their sets."""
    data, offsets = tc.text_buffer(table.column("text"))
    for low, high in tc.slices(offsets):
        yield low, high, shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], buckets)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (df + 1.0)) / np.log(n + 2)).astype(np.float32)


class Sampler:
    """Consistent weighted samples; all random numbers of a shingle and place are bits of the shingle's hash.

    With r, c ~ Gamma(2,1) and b ~ U(0,1), t = floor(ln w / r + b), and the shingle with the least ln a = ln c - r (t - b + 1)
    is the sample, which is named by shingle and t. The two Gamma numbers are quantiles at 12 and 16 bits, b has 20.
    """

    def __init__(self, places: int = PLACES, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.odd = rng.integers(1, 1 << 31, (places, 4), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.r, self.log_c = _gamma_quantiles(12).astype(np.float32), np.log(_gamma_quantiles(16)).astype(np.float32)
        self.inverse = 1 / self.r

    def sample(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(documents, places) uint64; a document without shingles must not be given."""
        high, low = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
        p, q, at = np.empty_like(high), np.empty_like(high), np.empty(len(h), np.intp)
        r, t, b = (np.empty(len(h), np.float32) for _ in range(3))
        log_w, sizes = np.log(w).astype(np.float32), np.diff(np.append(first[:-1], len(h)))
        out = np.empty((len(first) - 1, len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            _bits(high, low, odd[:2], p, q)
            at[:] = np.right_shift(p, np.uint32(20), out=q)
            self.r.take(at, out=r, mode="clip")
            self.inverse.take(at, out=t, mode="clip")
            p &= np.uint32(0xFFFFF)
            b[:] = p
            b *= np.float32(2.0**-20)
            t *= log_w
            t += b
            np.floor(t, out=t)
            np.subtract(t, b, out=b)
            b += np.float32(1)
            b *= r
            _bits(high, low, odd[2:], p, q)
            at[:] = np.right_shift(p, np.uint32(16), out=q)
            self.log_c.take(at, out=r, mode="clip")
            r -= b
            least = np.minimum.reduceat(r, first[:-1])
            best = np.flatnonzero(r == np.repeat(least, sizes))
            doc = np.searchsorted(first, best, "right") - 1
            one = np.flatnonzero(np.diff(doc, prepend=-1))  # the first of equal ones
            best = best[one]
            out[:, k] = tc.mix(h[best] + tc.mix(t[best].astype(np.int64).view(np.uint64)))
        return out


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Gamma(2,1) at the middles of 2**bits equal parts: 1 - (1 + x) exp(-x) inverted by Newton steps in ln x."""
    share = (np.arange(1 << bits) + 0.5) / (1 << bits)
    log_x = 0.5 * np.log(2 * share)
    for _ in range(60):
        x = np.exp(log_x)
        gap = -np.expm1(-x) - x * np.exp(-x) - share
        log_x -= np.clip(gap / np.maximum(x * x * np.exp(-x), 1e-300), -0.5, 0.5)
    return np.exp(log_x)


def _bits(high: np.ndarray, low: np.ndarray, odd: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """32 bits of a place's own mixture of both halves of the hash."""
    np.multiply(high, odd[0], out=out)
    np.multiply(low, odd[1], out=spare)
    out += spare


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the bands of samples."""
    seeds = tc.mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
    return tc.mix((sig * seeds).reshape(len(sig), BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=np.uint64))


_TOLD = "block long, bucket int, body binary, id long, key binary"


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        tc.release()
        found = [h for _, _, (h, _, _) in _slices(table, buckets)]
        keys, df = np.unique(np.concatenate(found), return_counts=True)
        rows = [(table.column("block")[0].as_py(), bucket, *pack_keys(keys[part], buckets), df[part].astype(np.uint32).tobytes()) for bucket, part in told(keys, buckets)]
        return pa.Table.from_batches([record_batch(rows, ["block", "bucket", "high", "low", "df"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])])

    return ask


def _answer(buckets: int):
    def answer(table: pa.Table) -> pa.Table:
        tc.release()
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack_keys(h, b) for h, b in zip(table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True)]
        df = np.concatenate([unpack(x, np.uint32) for x in table.column("df").to_pylist()])
        _, index = np.unique(np.concatenate(parts), return_inverse=True)
        whole = np.bincount(index, df).astype(np.uint32)[index]
        ends = np.cumsum([len(p) for p in parts])
        rows = [(b, bucket, whole[e - len(p) : e].tobytes(), None, None) for b, p, e in zip(table.column("block").to_pylist(), parts, ends, strict=True)]
        return pa.Table.from_batches([record_batch(rows, ["block", "bucket", "body", "id", "key"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()])])

    return answer


def _weighted(table: pa.Table, answers: pa.Table, buckets: int, n: int) -> Iterator[tuple]:
    """Document ranges of a block, with shingles, counts, idf and where each document's begin."""
    slices = list(_slices(table, buckets))
    keys = np.unique(np.concatenate([h for _, _, (h, _, _) in slices]))
    body = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True) if x is not None}
    parts = [unpack(body[bucket], np.uint32) for bucket, _ in told(keys, buckets)]
    idf = idf_of(np.concatenate(parts), n) if parts else np.zeros(0, np.float32)
    for low, high, (h, tf, first) in slices:
        yield low, high, h, tf, idf[np.searchsorted(keys, h)], first


def _sign(buckets: int, n: int):
    def sign(table: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds, parts = ["doc_id", "key", "sig", "buckets"], [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())], []
        sampler = Sampler()
        tc.release()
        for low, high, h, tf, idf, first in _weighted(table, answers, buckets, n) if len(table) else ():
            some = np.diff(first) > 0
            sig = sampler.sample(h, tf * idf, np.append(first[:-1][some], first[-1])) if some.any() else np.zeros((0, PLACES), np.uint64)
            packed, bands = iter(pack_signatures(sig)), iter(bands_of(sig).view(np.int64))
            rows = table.slice(low, high - low)
            columns = [[next(packed).tobytes() if s else None for s in some], [next(bands) if s else None for s in some]]
            ids = rows.column("doc_id").combine_chunks(), rows.column("key").combine_chunks()
            parts.append(pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names))
        return pa.Table.from_batches(parts, pa.schema(list(zip(names, kinds, strict=True))))

    return sign


def _bodies(buckets: int, n: int):
    """Packed sets of the documents that the answers name by id and key: all keys, then all weights.

    A shingle that occurs m times is m elements of the set, all of its idf: the least of two counts times idf is then what two sets share.
    """

    def find(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, wanted = [], set()
        tc.release()
        if len(table) and len(answers):
            wanted = {(i, k) for i, k in zip(answers.column("id").to_pylist(), answers.column("key").to_pylist(), strict=True) if i is not None}
        if wanted:
            names = list(zip(table.column("doc_id").to_pylist(), table.column("key").to_pylist(), strict=True))
            for low, _, h, tf, idf, first in _weighted(table, answers, buckets, n):
                for d in range(len(first) - 1):
                    if names[low + d] in wanted:
                        wanted.discard(names[low + d])
                        part = slice(first[d], first[d + 1])
                        times = tf[part]
                        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        keys = np.repeat(h[part], times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        rows.append((names[low + d][1], keys.tobytes() + np.repeat(idf[part], times).tobytes()))
        return pa.Table.from_batches([record_batch(rows, ["id", "body"], [pa.binary(), pa.binary()])])

    return find


def read_bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bodies = [x.as_buffer() for x in column]
    sizes = np.array([len(b) // 12 for b in bodies], np.int64)
    keys = [np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, sizes.tolist(), strict=True)]
    weights = [np.frombuffer(b, np.float32, n, 8 * n) for b, n in zip(bodies, sizes.tolist(), strict=True)]
    return np.concatenate(keys), np.concatenate(weights).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, kept) of every row of ``docs`` (doc_id, text); key is the text's MD5.

    Each text is classed by itself, also where one doc_id has several. class_id is the smallest doc_id of the class, kept says whether the row
    is that document with the text that stands for the class (of several texts of that doc_id in the class, the one of least MD5).
    """
    spark, n = docs.sparkSession, docs.count()
    blocks, buckets = layout(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5("text")))
    placed = docs.withColumn("block", block_by_hash(blocks, F.coalesce("doc_id", F.xxhash64("text")))).repartition(buckets, "block")
    with tidy(spark), Scratch(spark) as scratch:
        asked = placed.groupBy("block").applyInArrow(_ask(buckets), "block long, bucket int, high binary, low binary, df binary")
        answers = scratch.cut(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer(buckets), _TOLD))
        signed = cut(placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sign(buckets, n), "doc_id long, key binary, sig binary, buckets array<long>"))
        known = signed.where("doc_id is not null")
        # every text is an item of its own, whatever other texts its doc_id has; the first row of a text stands for it
        exact = scratch.cut(known.groupBy("key").agg(F.min("doc_id").alias("doc_id")))
        items = known.where("sig is not null").join(exact, ["doc_id", "key"], "left_semi").dropDuplicates(["key"])
        items = scratch.cut(items.select("doc_id", "key", "sig", "buckets"))

        def bodies(ids: DataFrame) -> DataFrame:
            asked = items.select(F.col("doc_id").alias("id"), "key").join(ids.withColumnRenamed("id", "key"), "key")
            asked = asked.select(block_by_hash(blocks, F.col("id")).alias("block"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("body"), "id", "key")
            found = placed.groupBy("block").cogroup(answers.union(asked).groupBy("block"))
            return found.applyInArrow(_bodies(buckets, n), "id binary, body binary")

        groups = near_classes(scratch, items.select(F.col("key").alias("id"), "sig", "buckets"), bodies, AGREE, read_bodies, SIMILARITY)
        linked = scratch.cut(exact.join(groups.withColumnRenamed("node", "key"), "key"))
        first = scratch.cut(linked.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")))
        linked = linked.join(first, "component").select("key", "first")
        one = F.coalesce("first", F.struct("doc_id", "key"))
        classes = cut(exact.join(linked, "key", "left").select("key", one["doc_id"].alias("class_id"), one["key"].alias("class_key")))
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    out = known.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "class_id", kept.alias("kept"))
    return out.union(signed.where("doc_id is null").select("doc_id", "key", F.lit(None).cast("long"), F.lit(None).cast("boolean")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate class; all columns stay, rows without doc_id too."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("__key"))
    chosen = keyed.where("__id is not null").join(kept, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return chosen.unionByName(keyed.where("__id is null")).select("__row.*")
