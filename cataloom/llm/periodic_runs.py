"""Periodic runs of words, found from window minima on several scales.

A run is a stretch of words with smallest period q and a length of at least ``max(SHORTEST, REPEATS * q)`` words that no
neighbour extends. Inside a run everything repeats at distance q, window minima too:

* For periods of a scale ``[low, high]``, runs of ``high`` words are hashed, and the least hash of each window of ``2 * low - high + 1``
  of them is marked. A run of three periods holds a whole window and the same window one period on, so its minimum is marked
  twice, q apart. As the hashed stretch is no shorter than the period, equal stretches within a run lie a multiple of q apart
  (else a divisor of q would be a period), so the *next* equal minimum is exactly one period away.
* Pairs of neighbouring equal minima at a distance within the scale are seeds. Each is extended both ways on the words
  themselves; hashes only propose. A seed stretch of ``high >= q`` words is a square, and squares with their
  extensions are few, so the extensions cost little beside the minima.
* Periods of up to ``DIRECT`` words would have no window to speak of: each is scanned as a lag over all words.

Documents are handled in slices of some megabytes, so no row is shuffled; a single document longer than that is one slice,
since a run may span it.

Defined results: null text has no words; rows without doc_id and repeated rows are judged like others; words are told apart by
their bytes; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc

#: Fixed values of the contract: words of the shortest run, and periods that it must hold.
SHORTEST, REPEATS = 24, 3
#: Periods that are scanned as lags.
DIRECT = 8

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SEED = np.uint64(0x9E3779B97F4A7C15)


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods, each half as wide as its least period, up to a third of ``longest`` words."""
    low = DIRECT + 1
    while low * REPEATS <= longest:
        high = low + low // 2
        yield low, high
        low = high + 1


class Slice:
    """The words of some documents: numbers equal for equal words, and each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = tc.BY_SPACE[0][data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[-1] = True
        edge[offsets] = True
        at = np.flatnonzero(edge)
        keep = inside[at[:-1]] if len(data) else np.zeros(0, bool)
        start, end = at[:-1][keep], at[1:][keep]
        self.first = np.searchsorted(start, offsets)
        size = end - start
        ends = np.concatenate([[0], np.cumsum(size)])
        letters = np.ascontiguousarray(data[inside]) if len(data) else data
        self.n = len(size)
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        # all words with one space behind each
        self.begin = ends + np.arange(self.n + 1)
        self.joined = np.full(len(letters) + self.n, 32, np.uint8)
        self.joined[np.arange(len(letters)) + np.repeat(np.arange(self.n), size)] = letters


def _window(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by windows of doubled width."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[: len(out) - step], out[step:]), have + step
    return out


def _blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tc.mix(a * np.uint64(0xD6E8FEB86659FD93) + tc.mix(b + _SEED))


def seeds(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, distance) of neighbouring equal window minima, distances within their scale, in order of (distance, place) in each scale."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(word))
    left = np.repeat(first[1:], counts) - place
    block, span = tc.mix(word.astype(np.uint64) + _SEED), 1
    with np.errstate(over="ignore"):
        for low, high in scales(int(counts.max(initial=0))):
            long = counts[owner] >= low * REPEATS
            if long.mean() < 0.75:  # go on with the documents that can hold such a period
                owner, place, left, block = owner[long], place[long], left[long], block[long]
            while span * 2 <= high:
                other = np.zeros_like(block)
                other[: len(block) - span] = block[span:]
                block, span = _blend(block, other), span * 2
            shift = high - span
            if len(block) <= high:
                continue
            stretch = _blend(block[: len(block) - shift], block[shift:])
            stretch[left[: len(stretch)] < high] = np.uint64(0xFFFFFFFFFFFFFFFF)
            width = min(2 * low - high + 1, len(stretch))
            least = _window(stretch, width, np.minimum)
            pad = np.zeros(width - 1, np.uint64)
            best = _window(np.concatenate([pad, least, pad]), width, np.maximum)
            marked = np.flatnonzero((stretch == best) & (left[: len(stretch)] >= high))
            key = tc.mix(stretch[marked] ^ tc.mix(owner[marked].astype(np.uint64) + _SEED))
            order = np.argsort(key, kind="stable")
            key, at = key[order], place[marked][order]
            distance = at[1:] - at[:-1]
            near = np.flatnonzero((key[1:] == key[:-1]) & (distance >= low) & (distance <= high))
            order = np.lexsort((at[near], distance[near]))
            yield from zip(at[near][order].tolist(), distance[near][order].tolist(), strict=True)


def _agree(word: np.ndarray, at: int, lag: int, end: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step`` up to ``end``, equal the word ``lag`` further."""
    size, got = 64, 0
    while at != end:
        stop = min(at + size, end) if step > 0 else max(at - size, end)
        low, high = (at, stop) if step > 0 else (stop, at)
        same = word[low:high] == word[low + lag : high + lag]
        if not same.all():
            return got + int(np.argmin(same if step > 0 else same[::-1]))
        got, at, size = got + high - low, stop, size * 2
    return got


def _divisors(period: int) -> list[int]:
    """The period divided by each of its prime factors: a smaller period of a run would divide one of these or be one."""
    out, rest, prime = [], period, 2
    while prime * prime <= rest:
        if rest % prime == 0:
            out.append(period // prime)
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return out + ([period // rest] if rest > 1 else [])


def runs_of(word: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run in the slice, sorted; starts count over the whole slice."""
    found, n = [], len(word)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(n)
    for lag in range(1, min(DIRECT, n - 1) + 1):
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = (word[:-lag] == word[lag:]) & (left[:-lag] > lag)
        turn = np.flatnonzero(np.diff(same))
        begin, size = turn[::2], turn[1::2] - turn[::2] + lag
        keep = size >= max(SHORTEST, REPEATS * lag)
        found += [(b, lag, s) for b, s in zip(begin[keep].tolist(), size[keep].tolist(), strict=True)]
    last = (0, -1)  # distance and end of the stretch extended last: seeds inside it say nothing new
    for at, lag in seeds(word, first):
        if last[0] == lag and at < last[1]:
            continue
        doc = int(np.searchsorted(first, at, "right")) - 1
        ahead = _agree(word, at, lag, int(first[doc + 1]) - lag, 1)
        begin = at - _agree(word, at, lag, int(first[doc]), -1)
        last = (lag, at + ahead)
        if (size := at + ahead - begin + lag) >= max(SHORTEST, REPEATS * lag):
            found.append((begin, lag, size))
    primitive = lambda b, q: not any(np.array_equal(word[b : b + q], word[b + d : b + d + q]) for d in _divisors(q))
    return sorted({r for r in found if primitive(r[0], r[1])})


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.text_buffer(batch.column(1))
        for low, high in tc.slices(offsets, 4 * tc.SLICE):
            part = Slice(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            by_doc: dict[int, list[tuple[int, int, int]]] = {}
            for run in runs_of(part.word, part.first):
                by_doc.setdefault(int(np.searchsorted(part.first, run[0], "right")) - 1, []).append(run)
            runs, texts = [], []
            for doc in range(high - low):
                a, b = int(part.first[doc]), int(part.first[doc + 1])
                text = part.joined[part.begin[a] : part.begin[b]]
                if own := by_doc.get(doc):
                    keep = np.ones(b - a, bool)
                    for start, period, length in own:
                        keep[start - a + period : start - a + length] = False
                    text = text[np.repeat(keep, np.diff(part.begin[a : b + 1]))]
                runs.append([{"start": s - a, "length": n, "period": q} for s, q, n in own or ()])
                texts.append(text[:-1].tobytes())
            columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(part.first), pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs`` are (start, length, period) by start, then period; ``collapsed`` are the words, joined by single spaces, without those that some
    run holds after its first period.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_judge, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length over period, the first of such; null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | more(best, x), x).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The columns of ``find_runs`` as counts, the strongest run and digests."""
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return best.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the checksum of doc_id, repeats some of its words from some place on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.expr("1 + (size(words) - a) div (3 + (h div 10) % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), text).otherwise(F.col("text")).alias("text"))
