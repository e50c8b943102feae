"""Scores of whole texts under a hidden Markov language model trained on the corpus.

Tokens are words between ASCII white space, ASCII letters lowered, and one end per document. A word belongs
to a class: the commonest training words have one each, the others share ``SHAPES`` classes by their
first and last two bytes; how many have their own grows with the number of distinct words. A document's classes are
emitted by ``STATES`` hidden states; a word is then drawn within its class by its training count plus one, with one unit for all
unseen words, so the whole is a probability over all texts. Baum-Welch runs over all training documents, whole: each
partition sends its expected counts, which Spark adds up, until a round gains less than ``GAIN`` of the likelihood, ``ROUNDS`` times at most.

Long documents are handled in pieces of ``PIECE`` tokens at once, in training as in scoring: each piece is run from every
state, the pieces are chained forward and backward, so that what crosses from one to the next counts as in one run.

Word counts are exchanged between blocks of documents and buckets of word hashes (see exchange.py), so that
a word costs one entry per block; words are told apart by 64-bit hashes. Defined results: null text is empty (one token, the
end); a null doc_id counts as the empty text for the split; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc
from cataloom.llm.exchange import block_by_hash, layout, record_batch, told, unpack
from cataloom.llm.scratch import Scratch, cut, tidy

STATES, SHAPES, ROUNDS, GAIN, PIECE, SCALED = 6, 2048, 4, 0.002, 512, 8
#: Words with a class of their own: one in so many distinct words, but so many at least, and at most.
OWN_SHARE, LEAST_OWN, MOST_OWN = 64, 1_024, 65_536
#: Key of the end token; a word with this hash gets the next one.
END_KEY = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape class of every token, each document's end included, and the documents' first tokens."""
    found = tc.words(data, offsets, tc.BY_SPACE)
    fold = tc.BY_SPACE[1]
    last = len(data) - 1
    edge = [fold[data[np.clip(at, 0, max(last, 0))]].astype(np.uint64) for at in (found.start, np.minimum(found.start + 1, found.end - 1), np.maximum(found.end - 2, found.start), found.end - 1)] if len(data) else [np.zeros(0, np.uint64)] * 4
    shape = tc.mix(edge[0] | edge[1] << np.uint64(8) | edge[2] << np.uint64(16) | edge[3] << np.uint64(24)) % np.uint64(SHAPES)
    n = len(offsets) - 1
    first = found.first + np.arange(n + 1)
    keys, shapes = np.full(first[-1], END_KEY, np.uint64), np.full(first[-1], SHAPES, np.int32)
    place = np.arange(len(found.hash)) + found.doc
    keys[place], shapes[place] = found.hash + (found.hash == END_KEY), shape
    return keys, shapes, first


class Block:
    """Tokens of a block of documents, reduced to its distinct words."""

    def __init__(self, table: pa.Table):
        data, offsets = tc.text_buffer(table.column("text"))
        parts, docs = [], 0
        self.first = np.zeros(1, np.int64)
        for low, high in tc.slices(offsets, tc.CACHED):
            keys, shapes, first = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            parts.append((keys, shapes))
            self.first = np.concatenate([self.first, first[1:] + self.first[-1]])
        keys, self.shapes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys, at, self.word = np.unique(keys, return_index=True, return_inverse=True)
        self.shape = self.shapes[at]
        train = np.repeat(~table.column("held_out").to_numpy(), np.diff(self.first))
        self.count = np.bincount(self.word[train], minlength=len(self.keys)).astype(np.int64)


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        block = Block(table)
        number = table.column("block")[0].as_py()
        rows = [(number, bucket, block.keys[part].tobytes(), block.count[part].tobytes(), block.shape[part].astype(np.int16).tobytes()) for bucket, part in told(block.keys, buckets)]
        return pa.Table.from_batches([record_batch(rows, ["block", "bucket", "keys", "counts", "shapes"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])])

    return ask


_TOLD = "kind string, block long, bucket int, body binary, word long, shape int, count long, words long"


def _count(table: pa.Table) -> pa.Table:
    """Answers: each asked word's count. Also counts and words of each shape, and the bucket's commonest words."""
    bucket = table.column("bucket")[0].as_py()
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    shapes = np.concatenate([unpack(x, np.int16) for x in table.column("shapes").to_pylist()])
    words, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, inverse, counts)
    shape = shapes[at].astype(np.int64)
    answers, ends = total[inverse], np.cumsum([len(k) for k in keys])
    rows = [("answer", b, bucket, answers[e - len(k) : e].tobytes(), None, None, None, None) for b, k, e in zip(table.column("block").to_pylist(), keys, ends, strict=True)]
    by_shape, known = np.bincount(shape, total, SHAPES + 1).astype(np.int64), np.bincount(shape, total > 0, SHAPES + 1).astype(np.int64)
    rows += [("shape", None, bucket, None, None, int(s), int(by_shape[s]), int(known[s])) for s in np.flatnonzero(by_shape)]
    some = np.flatnonzero((total > 0) & (words != END_KEY))
    top = some[np.lexsort((words[some], -total[some]))[: max(LEAST_OWN, len(some) // 8)]]  # words are dealt evenly: no bucket has more of the commonest
    rows += [("top", None, bucket, None, int(words[i].astype(np.int64)), int(shape[i]), int(total[i]), None) for i in top]
    names = [x.split()[0] for x in _TOLD.split(", ")]
    return pa.Table.from_batches([record_batch(rows, names, [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])])


def own_words(types: int) -> int:
    """How many words have a class of their own where there are so many distinct ones; a power of two."""
    return min(MOST_OWN, max(LEAST_OWN, 1 << (max(types // OWN_SHARE, 1).bit_length() - 1)))


class Classes:
    """Class of a word, and totals of classes: first those of one word each, then SHAPES shared ones, then the end."""

    def __init__(self, top: list, shapes: list):
        words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.rank, self.own = words[order], order, len(top)
        self.size = self.own + SHAPES + 1
        self.total, self.known = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for r in shapes:
            self.total[self.own + r["shape"]], self.known[self.own + r["shape"]] = r["count"], r["words"]
        self.all, self.types = int(self.total.sum()), int(self.known.sum())
        for i, r in enumerate(top):
            self.total[self.own + r["shape"]] -= r["count"]
            self.known[self.own + r["shape"]] -= 1
            self.total[i] = r["count"]

    def of(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = self.own + shapes.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
            hit = self.words[at] == keys
            out[hit] = self.rank[at[hit]]
        return out

    def log_within(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | class); certain for classes of one word and the end."""
        shared = (cls >= self.own) & (cls != self.size - 1)
        return np.where(shared, np.log10((count + 1) / (self.total[cls] + self.known[cls] + 1)), 0.0)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, total: np.ndarray) -> Model:
        """States that stay, and emit the classes by their counts, each with a random tilt (fixed seed)."""
        rng = np.random.Generator(np.random.PCG64(11))
        emit = (total + 1.0) * rng.gamma(2.0, 0.5, (STATES, len(total)))
        emit[:, -1] = total[-1] + 1.0
        move = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Model:
        start, move, emit = counts[0, :STATES] + 0.1, counts[1 : STATES + 1, :STATES] + 0.1, counts[STATES + 1 :] + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _layout(first: np.ndarray, length: np.ndarray):
    """Sequences by falling length, and for each time the places of those still running."""
    order = np.argsort(-length, kind="stable")
    begin, length = first[order], length[order]
    running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    return order, begin, running


def _pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first token and length of each piece."""
    sizes = np.diff(first)
    n = -(-sizes // PIECE)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[doc] + nth * PIECE
    return doc, begin, np.minimum(PIECE, first[doc + 1] - begin)


class Chain:
    """Pieces of some documents with what reaches each from the pieces before it, and the likelihood of the whole."""

    def __init__(self, model: Model, cls: np.ndarray, first: np.ndarray):
        self.model, self.cls, self.emit = model, cls, np.ascontiguousarray(model.emit.T)
        self.doc, self.begin, self.length = _pieces(first)
        n = len(self.doc)
        self.head = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if n else np.zeros(0, bool)
        self.reach = np.empty((n, STATES))  # the state before each piece; of a first piece, the start
        self.reach[self.head] = model.start
        self.log = np.zeros(len(first) - 1)
        rest = np.flatnonzero(~self.head)
        self.through = np.zeros((n, STATES, STATES))  # from the state before a piece to that at its end, scaled
        state, log = self._run(np.flatnonzero(self.head), self.reach[self.head])
        self.log[self.doc[self.head]] = log
        if not len(rest):
            return
        self.through[rest], top = self._run(rest, np.tile(np.eye(STATES), (len(rest), 1, 1)))  # from each state in turn
        alpha = np.zeros((len(first) - 1, STATES))
        alpha[self.doc[self.head]] = state
        for i, piece in enumerate(rest.tolist()):
            d = self.doc[piece]
            self.reach[piece] = alpha[d]
            x = alpha[d] @ self.through[piece]
            s = x.sum()
            alpha[d], self.log[d] = x / s, self.log[d] + top[i] + np.log10(s)

    def _run(self, pieces: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State at the end and log10 likelihood of some pieces, from the states before them; several of a piece share their scale.

        Scaled every ``SCALED`` tokens, between which a double does not run out.
        """
        order, begin, running = _layout(self.begin[pieces], self.length[pieces])
        head, a, log = self.head[pieces][order], before[order].reshape(len(order), STATES if before.ndim > 2 else 1, STATES), np.zeros(len(order))
        a[~head] = a[~head] @ self.model.move

        def scale(n: int) -> None:
            s = a[:n].sum((1, 2))
            a[:n] /= s[:, None, None]
            log[:n] += np.log10(s)

        for t, n in enumerate(running):
            if t:
                a[:n] = (a[:n].reshape(-1, STATES) @ self.model.move).reshape(n, -1, STATES)
            a[:n] *= self.emit[self.cls[begin[:n] + t]][:, None]
            if t % SCALED == SCALED - 1:
                scale(n)
        scale(len(order))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return a[back].reshape(before.shape), log[back]

    def behind(self) -> np.ndarray:
        """Of each piece, how likely what follows in its document is from each state at its end, scaled."""
        out = np.ones((len(self.doc), STATES))
        for piece in np.flatnonzero(~self.head)[::-1].tolist():
            x = self.through[piece] @ out[piece]
            out[piece - 1] = x / x.sum()
        return out


def expected(model: Model, cls: np.ndarray, first: np.ndarray, counts: np.ndarray) -> float:
    """Adds the expected counts of some whole documents: scaled forward and backward recursions. Returns their log10 likelihood."""
    chain, ones = Chain(model, cls, first), np.ones((STATES, 1))
    order, begin, running = _layout(chain.begin, chain.length)
    head, before, behind = chain.head[order], chain.reach[order], chain.behind()[order]
    entering = np.where(head[:, None], before, before @ model.move)
    forward, seen = [], []
    for t, n in enumerate(running):
        now = chain.emit[cls[begin[:n] + t]]
        a = (entering if t == 0 else forward[-1][:n] @ model.move) * now
        forward.append(a / (a @ ones))
        seen.append(now)
    moves, back, places, gammas = np.zeros((STATES, STATES)), np.zeros((0, STATES)), [], []
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        if len(back) < n:
            ending = behind[len(back) : n]
            back = np.concatenate([back, ending / ((forward[t][len(back) :] * ending) @ ones)])
        places.append(cls[begin[:n] + t])
        gammas.append(forward[t] * back)
        weighted = seen[t] * back
        if t:
            onward = weighted @ model.move.T
            whole = (forward[t - 1][:n] * onward) @ ones
            moves += forward[t - 1][:n].T @ (weighted / whole)
            back = onward / whole
    if len(running):
        counts[0, :STATES] += gammas[-1][head].sum(0)
        rest = ~head  # moves from one piece into the next
        onward = weighted[rest] @ model.move.T
        moves += before[rest].T @ (weighted[rest] / (before[rest] * onward).sum(1, keepdims=True))
        place, gamma = np.concatenate(places), np.concatenate(gammas)
        for k in range(STATES):
            counts[STATES + 1 + k] += np.bincount(place, gamma[:, k], counts.shape[1])
    counts[1 : STATES + 1, :STATES] += moves * model.move
    return float(chain.log.sum())


def log_likelihood(model: Model, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 P(classes) of each whole document."""
    return Chain(model, cls, first).log


#: Tokens that a round of training handles at a time.
TOGETHER = 1 << 20


def _classified(shared):
    """The classes of all tokens of each text, packed; what does not change from round to round is done once."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        kind = class_kind(classes.size)
        for batch in batches:
            data, offsets = tc.text_buffer(batch.column(0))
            for low, high in tc.slices(offsets):
                keys, shapes, first = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                packed, places = classes.of(keys, shapes).astype(kind), (first * kind().itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(places), pa.py_buffer(packed)])], ["classes"])

    return classify


def class_kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _train(docs: DataFrame, classes: Classes) -> Model:
    """Baum-Welch over the training rows (text) of ``docs``; only sums of the size of the model reach the driver."""
    with Scratch(docs.sparkSession) as scratch:
        shared = docs.sparkSession.sparkContext.broadcast(classes)
        return _rounds(scratch.cut(docs.select("text").mapInArrow(_classified(shared), "classes binary")), classes)


def _rounds(docs: DataFrame, classes: Classes) -> Model:
    """The rounds over the packed classes of texts."""
    context, model, before, size = docs.sparkSession.sparkContext, Model.first(classes.total), None, classes.size
    kind = class_kind(size)
    for _ in range(ROUNDS):
        shared = context.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2 * STATES + 1, size))
            for batch in batches:
                data, offsets = tc.text_buffer(batch.column(0))
                cls, first = data.view(kind), offsets // kind().itemsize
                for low, high in tc.slices(first, TOGETHER):
                    counts[0, STATES] += expected(shared.value, cls[first[low] : first[high]], first[low : high + 1] - first[low], counts)  # a spare place
            yield record_batch([(i, x.tobytes()) for i, x in enumerate(counts)], ["row", "counts"], [pa.int32(), pa.binary()])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[row] = sums.get(row, 0) + unpack(raw, np.float64)
            yield record_batch([(r, x.tobytes()) for r, x in sums.items()], ["row", "counts"], [pa.int32(), pa.binary()])

        parts = docs.mapInArrow(count, "row int, counts binary")
        rows = parts.repartition(2 * STATES + 1, "row").mapInArrow(add, "row int, counts binary").collect()
        if not rows:
            break
        counts = np.stack([unpack(r["counts"], np.float64) for r in sorted(rows, key=lambda r: r["row"])])
        model, likelihood = Model.from_counts(counts), counts[0, STATES]
        if before is not None and likelihood - before < GAIN * abs(before):
            break
        before = likelihood
    return model


def _score(buckets: int, shared):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not len(table):
            return pa.Table.from_batches([record_batch([], names, kinds)])
        model, classes = shared.value
        block = Block(table)
        body = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
        count = np.concatenate([unpack(body[bucket], np.int64) for bucket, _ in told(block.keys, buckets)])
        cls = classes.of(block.keys, block.shape)
        word, first = block.word, block.first[:-1]
        add = lambda x: np.add.reduceat(x[word], first)
        base = add(np.log10((count + 1) / (classes.all + 1 * (classes.types + 1))))
        whole = log_likelihood(model, cls[word], block.first) + add(classes.log_within(cls, count))
        n = len(table)
        columns = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), np.diff(block.first), add((count > 0).astype(np.int64)), np.full(n, classes.all), base, whole]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return score


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    placed, answers, model, classes, buckets = learned(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, classes))
    found = placed.groupBy("block").cogroup(answers.groupBy("block"))
    return found.applyInArrow(_score(buckets, shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learned(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model, Classes, int]:
    """Rows of ``docs`` in blocks, what their blocks are told of their words, the model, the classes, and the number of buckets."""
    blocks, buckets = layout(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    placed = docs.select(block_by_hash(blocks, F.coalesce("doc_id", F.xxhash64("text"))).alias("block"), "*").repartition(buckets, "block")
    with tidy(docs.sparkSession):
        asked = placed.groupBy("block").applyInArrow(_ask(buckets), "block long, bucket int, keys binary, counts binary, shapes binary")
        told_ = cut(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, _TOLD))
        shapes = told_.where("kind = 'shape'").groupBy("shape").agg(F.sum("count").alias("count"), F.sum("words").alias("words")).collect()  # SHAPES + 1 rows at most
        own = own_words(sum(r["words"] for r in shapes))
        # written in order first: a limit behind a sort would send as many rows from every partition to the driver
        ranked = cut(told_.where("kind = 'top'").select("word", "shape", "count").orderBy(F.desc("count"), "word"))
        top = ranked.limit(own).collect()  # MOST_OWN rows at most
        classes = Classes(top, shapes)
        model = _train(docs.where("not held_out"), classes)
    return placed, told_.where("kind = 'answer'").select("block", "bucket", "body"), model, classes, buckets
