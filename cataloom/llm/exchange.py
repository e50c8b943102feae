"""Question-and-answer exchange between blocks of documents and buckets of 64-bit keys.

Counting or looking up every key of a corpus row by row would shuffle one row per word or byte position.
Here documents are grouped in blocks of some megabytes; a block sends each bucket its sorted
distinct keys once, packed as arrays, and gets one answer per key back in the same order. A key that very many
documents hold therefore costs one entry per block, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: MB of text per partition of blocks and per bucket.
PARTITION_MB = 40


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by one scan of that column; the planner's estimate is far off behind a join."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0


def partitions(docs: DataFrame) -> int:
    """Number of partitions for ``docs``: of PARTITION_MB of text, and larger ones from about 1 TB on, up to eight times that."""
    size = text_bytes(docs)
    target = min(max(PARTITION_MB << 20, int((size / (1 << 20)) ** 0.5 * (40 << 10))), 8 * PARTITION_MB << 20)
    return max(4, size // target + 1)


def layout(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and buckets (a power of two) for ``docs`` by their texts' bytes; blocks grow with the input, up to 32 MB each.

    A row of the exchange stands for a block and a bucket: with larger blocks there are fewer of them, and each is packed better.
    """
    size = text_bytes(docs)
    block = min(max(4 << 20, int((size / (1 << 20)) ** 0.5 * (1 << 17))), 32 << 20)
    return size // block + 1, max(4, 1 << int(size // (20 << 20)).bit_length())


def block_by_hash(blocks: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("long")


def range_bounds(docs: DataFrame, blocks: int) -> np.ndarray:
    """Sorted last doc_ids of about ``blocks`` ranges of like size in bytes; ids may be of any distribution.

    Spark's range partitioning places the ids; within a partition, running sums of bytes cut it where texts are long.
    One number per block comes to the driver, a ten-millionth of the input.
    """
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes")).groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    placed = sized.repartitionByRange(blocks, "doc_id").withColumn("part", F.spark_partition_id())
    target = F.lit(max((text_bytes(docs) // blocks) * 2, 1))
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("doc_id"))
    ends = placed.select("part", "doc_id", F.floor(running / target).alias("cut")).groupBy("part", "cut").agg(F.max("doc_id").alias("last"))
    return np.sort(np.array([r["last"] for r in ends.select("last").collect()], np.int64))


#: Bits of a key that count within its bucket. A bucket holds some millions of keys at any size of the input, so that two meet by chance with
#: a probability of about one in 200,000.
KEY_BITS = 40


def shorten(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys without the bits that the exchange would drop."""
    drop = 64 - KEY_BITS - (buckets.bit_length() - 1)
    return keys if drop <= 0 else keys >> np.uint64(drop) << np.uint64(drop)


def told(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys, a power of two of them, and the part of the keys in each."""
    bits = buckets.bit_length() - 1
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, slice(int(edges[bucket]), int(edges[bucket + 1]))


def pack_keys(keys: np.ndarray, buckets: int) -> tuple[bytes, bytes]:
    """The KEY_BITS bits of each key behind those that name its bucket: the upper 32, and the other 8."""
    inside = keys << np.uint64(buckets.bit_length() - 1)
    return (inside >> np.uint64(32)).astype(np.uint32).tobytes(), (inside >> np.uint64(24)).astype(np.uint8).tobytes()


def unpack_keys(upper: bytes, lower: bytes) -> np.ndarray:
    """What ``pack_keys`` kept of each key of one bucket; equal numbers are equal keys."""
    return np.frombuffer(upper, np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(lower, np.uint8)


def unpack(value: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(value, kind)


def record_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
