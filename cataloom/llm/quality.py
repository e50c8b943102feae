"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model is fitted on a bounded sample of labelled rows (``SAMPLE``, by hash of doc_id, one row a doc_id): marks of junk
(shouting, symbols, table bars, repetition) and the presence of ``WORDS`` telling words. A document is bad if its
label says low quality or toxic. The model's probability of every document is then summed up by host and by
path; a host's rate of good documents is shrunk toward the rate of the whole corpus, a path's toward its
host's, by strengths estimated from how much hosts, and paths within hosts, differ (method of moments).
A document's own evidence is left out of its groups' sums, then added in log odds.

The host is ``source`` up to its first slash, the path is the whole ``source`` and the language. Telling words are chosen by
a grouped count in Spark; the driver gets marks and at most ``WORDS`` flags of the sampled rows, whatever their length.
Defined results: columns of any name are carried through untouched; null text is empty, null source or language is ''; without labels of both kinds the model says
nothing and every document is kept; repeated rows count as often as they occur; rows without doc_id are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cataloom.llm import textcore as tc
from cataloom.llm.scratch import Scratch, cut, tidy

#: Labelled rows that the model is fitted on, at most; words it uses at most; probability of being good under which a document is rejected.
SAMPLE, WORDS, REJECT = 20_000, 512, 0.5
#: Groups that may be broadcast; with more of them the join is shuffled.
FEW_GROUPS = 20_000
_MARKS = 9


def _share_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.float64)
    table[list(chars)] = 1
    return table


_KINDS = [
    _share_table(bytes(range(65, 91))),
    _share_table(b"!$%&*#@^~"),
    _share_table(b"|"),
    _share_table(b"0123456789"),
    _share_table(b".,;:"),
]


def evidence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of each document (documents, _MARKS), and its distinct word hashes with their first index."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    words = tc.words(data, offsets)
    h, count, first = tc.weighted_sets(words.hash, words.first)
    marks = np.zeros((n, _MARKS))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    for k, kind in enumerate(_KINDS):
        marks[:, k] = np.bincount(doc, kind[data], n) / size
    total = np.maximum(np.diff(words.first), 1)
    marks[:, 5] = np.diff(first) / total  # distinct words
    marks[:, 6] = np.bincount(words.doc, words.end - words.start, n) / total / 10
    marks[:, 7] = np.log1p(np.diff(words.first)) / 10
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    marks[:, 8] = np.bincount(words.doc, same, n) / total
    return marks, h, first


@dataclass
class Model:
    """Logistic model; ``keys`` are sorted. The base is the rate of good documents in the sample."""

    keys: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    marks: np.ndarray
    bias: float

    def logit(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        marks, h, first = evidence(data, offsets)
        out = self.bias + _curve(marks, self.mean, self.scale) @ self.marks
        if len(self.keys) and len(h):
            at, hit = _places(self.keys, h)
            value = np.where(hit, self.weights[at], 0.0)
            out += np.bincount(np.repeat(np.arange(len(out)), np.diff(first)), value, len(out))
        return np.clip(out, -30, 30)


def _curve(marks: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((marks - mean) / scale, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model | None:
    """A model from labelled rows of ``docs``, at most SAMPLE of them and one a doc_id, or None where both kinds of label are not there."""
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.coalesce("quality", F.lit(1)) == 0).alias("low"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), (F.col("quality").isNull() & F.col("toxic").isNull()).alias("unknown"))
    chosen = labels.where("label_id is not null and not unknown").groupBy("label_id").agg(F.max(F.col("low") | F.col("toxic")).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(chosen), "label_id")
    # one row a label, however many rows a doc_id has: SAMPLE rows at most. Written, as three passes read them
    rows = scratch.cut(rows.groupBy("label_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("bad").alias("bad")).select("text", "bad"))
    keys = _telling(rows)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tc.release()
            data, offsets = tc.text_buffer(batch.column(0))
            for low, high in tc.slices(offsets):
                marks, h, first = evidence(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                place, hit = _places(keys, h)
                lists = [tc.list_array(marks.ravel(), np.arange(high - low + 1) * _MARKS, pa.float64()), tc.list_array(place[hit].astype(np.int16), np.concatenate([[0], np.cumsum(hit)])[first], pa.int16())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), *lists], ["bad", "marks", "words"])

    shown = rows.mapInArrow(show, "bad boolean, marks array<double>, words array<short>").toArrow()
    bad = shown.column("bad").to_numpy().astype(bool)
    if not bad.any() or bad.all():
        return None
    marks = shown.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, _MARKS)
    lists = shown.column("words").combine_chunks()
    x = np.zeros((len(bad), len(keys)), np.float32)
    x[np.repeat(np.arange(len(bad)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    mean, scale = marks.mean(0), marks.std(0) + 1e-3
    x = np.concatenate([x, _curve(marks, mean, scale).astype(np.float32), np.ones((len(bad), 1), np.float32)], axis=1)
    w = _logistic(x, (~bad).astype(np.float32))
    n = len(keys)
    return Model(keys, w[:n], mean, scale, w[n : n + 2 * _MARKS], float(w[-1]))


def _places(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``h`` stands in the sorted ``keys``, and whether it is one of them."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _telling(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the WORDS words whose share of bad rows (text, bad) is furthest from that of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tc.release()
            data, offsets = tc.text_buffer(batch.column(0))
            bad = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in tc.slices(offsets):
                _, h, first = evidence(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                words, index = np.unique(h, return_inverse=True)
                of_bad = np.bincount(index, np.repeat(bad[low:high], np.diff(first)), len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(index, minlength=len(words))), pa.array(of_bad.astype(np.int64))], ["word", "n", "bad"])

    share = rows.agg(F.avg(F.col("bad").cast("int")).alias("share")).collect()[0]["share"] or 0.0
    sums = rows.mapInArrow(count, "word long, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n >= 4")
    surprise = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = sums.select("word", surprise.alias("surprise")).where("surprise > 3").orderBy(F.desc("surprise"), "word").limit(WORDS).collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 15) -> np.ndarray:
    """Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * np.append(w[:-1], 0)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.append(np.full(len(w) - 1, penalty), 1e-6)) + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-3:
            break
    return w


def score(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``docs`` with the model's log odds of being good as a new column ``name``; one pass, no shuffle."""
    if model is None:
        return docs.withColumn(name, F.lit(30.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tc.release()
            data, offsets = tc.text_buffer(batch.column(batch.schema.get_field_index("text")))
            parts = [shared.value.logit(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in tc.slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def sites(scored: DataFrame) -> DataFrame:
    """(__host, __path, __n, __s, __hn, __hs, ...) of every path: sums of evidence and what they shrink toward."""
    paths = cut(scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("__n"), F.sum("__p").alias("__s")))
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))
    total = hosts.agg(F.sum("__hn").alias("n"), F.sum("__hs").alias("s")).collect()[0]
    base = min(max((total["s"] or 0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
    host_strength = _strength(hosts.select(F.col("__hn").alias("n"), F.col("__hs").alias("s"), F.lit(base).alias("toward")))
    shrunk = hosts.withColumn("__toward", (F.col("__hs") + host_strength * base) / (F.col("__hn") + host_strength))
    joined = paths.join(shrunk, "__host")
    path_strength = _strength(joined.select(F.col("__n").alias("n"), F.col("__s").alias("s"), F.col("__toward").alias("toward")))
    return joined.withColumns({"__base": F.lit(base), "__host_strength": F.lit(host_strength), "__path_strength": F.lit(path_strength)})


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents that groups are shrunk by: within over between variance, from n, s and the rate ``toward``."""
    inside = F.col("toward") * (1 - F.col("toward"))
    gap = F.col("s") / F.col("n") - F.col("toward")
    r = groups.where("n > 1").agg(F.sum(F.col("n") * gap * gap).alias("spread"), F.sum(inside).alias("noise"), F.sum("n").alias("n"), F.avg(inside).alias("inside")).collect()[0]
    if not r["n"]:
        return 10.0
    between = max((r["spread"] - r["noise"]) / r["n"], 1e-9)
    return float(min(max(r["inside"] / between, 2.0), 10_000.0))


def _path(source: Column, lang: Column) -> dict[str, Column]:
    source, lang = F.coalesce(source.cast("string"), F.lit("")), F.coalesce(lang.cast("string"), F.lit(""))
    return {"__host": F.substring_index(source, "/", 1), "__path": F.concat_ws("/", source, lang)}


def judge(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with __doc_score (log odds from the text), __host, __path, __host_rate, __path_rate, __posterior, __keep.

    ``columns`` are the columns of ``docs`` to carry through; all by default. They travel as one struct, so that
    their names meet none of those used here; a column of ``docs`` with one of the eight names above is hidden.
    """
    out = _judged(docs, labels, columns)
    told = ["__doc_score", "__host", "__path", "__host_rate", "__path_rate", "__posterior", "__keep"]
    names = [c for c in (docs.columns if columns is None else columns) if c not in told]
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in names], *told)


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(__row, __doc_score, __host, __path, __host_rate, __path_rate, __posterior, __keep), __row with the columns to carry."""
    carried = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]
    with tidy(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        model = fit(docs, labels, scratch)
        light = score(docs.select("text", "source", "lang"), model, "__doc_score").select("__doc_score", "source", "lang")
        light = light.withColumns(_path(F.col("source"), F.col("lang"))).withColumn("__p", _chance(F.col("__doc_score")))
        groups = cut(sites(light.select("__host", "__path", "__p")))
    full = score(docs.select(F.struct(*carried).alias("__row"), "text", "source", "lang"), model, "__doc_score").drop("text")
    full = full.withColumns(_path(F.col("source"), F.col("lang"))).withColumn("__p", _chance(F.col("__doc_score")))
    small = groups.count() <= FEW_GROUPS
    joined = full.join(F.broadcast(groups) if small else groups, ["__host", "__path"])
    odds = lambda c: F.log(c / (1 - c))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    # a document's own evidence is taken out of its host and its path
    host = bound((F.col("__hs") - F.col("__p") + F.col("__host_strength") * F.col("__base")) / (F.col("__hn") - 1 + F.col("__host_strength")))
    path = bound((F.col("__s") - F.col("__p") + F.col("__path_strength") * F.col("__host_rate")) / (F.col("__n") - 1 + F.col("__path_strength")))
    out = joined.withColumn("__host_rate", host).withColumn("__path_rate", path)
    out = out.withColumn("__posterior", _chance(F.col("__doc_score") - odds(F.col("__base")) + odds(F.col("__path_rate"))))
    return out.withColumn("__keep", F.col("__posterior") >= REJECT)


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with the columns of ``docs``."""
    return _judged(docs, labels).where("__keep").select("__row.*")
