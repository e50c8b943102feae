"""Near-duplicate embeddings: robust-pruned graphs on overlapping shards, range-expanding greedy search.

1. Vectors with equal bytes are one point. Centroids of a bounded sample (``SAMPLE``) split the points in clusters;
   every point belongs to its ``overlap`` nearest clusters. A cluster of more than ``SHARD`` points is dealt over
   several shards by hash.
2. In each shard the nearest neighbours of every point are thinned by robust pruning to at most ``DEGREE``
   edges. The adjacency lists of a point's shards are united.
3. Every point is searched in its clusters' shards: a greedy beam goes from the shard's medoid to the
   point's surroundings; from there the search spreads over all points of cosine at least ``SPREAD``.
   Pairs of cosine 0.9 or more in double precision are links.
4. The links of ``AUDIT`` points are compared with brute force over all points, in blocks. Recall is the mean over points,
   taken apart for points of at most ``SPARSE`` links and for the others; the lower one counts. Under ``RECALL`` the search is
   repeated with twice the overlap, and beyond an overlap of ``MOST_OVERLAP`` all pairs of points are compared.

Vectors that are null or empty, zero, or hold null or non-finite components link with nothing. Vectors of
different lengths do not link. Rows of equal vec_id and components are one vector; rows without vec_id link with nothing and
have no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.components import components
from cataloom.llm.exchange import record_batch
from cataloom.llm.scratch import Scratch, cut, tidy

COSINE, SPREAD, SAMPLE, SHARD, NEAREST, DEGREE, BEAM, ALPHA, AUDIT, RECALL = 0.9, 0.8, 20_000, 2_000, 32, 16, 12, 1.2, 512, 0.97
#: Bytes of vectors that the driver holds for centroids, or for the audit, at most.
SAMPLE_BYTES = 64 << 20
#: Points per cluster that centroids are made for, and clusters at most (their size is what is broadcast).
CLUSTER, MOST_CLUSTERS = 1_500, 4_096
#: Overlap at which the search is given up, points of at most so many links that count as sparse, rows of a block of the exact comparison.
MOST_OVERLAP, SPARSE, EXACT_ROWS = 16, 16, 2_048
#: Points that the search spreads from at a time, and queries searched together.
FRONTIER, QUERIES = 1 << 15, 1_024


def _units(column: pa.Array) -> list[bytes | None]:
    """Each vector at length 1 as bytes of doubles; None where it cannot link."""
    out = []
    for value in column:
        unit = None
        if value.is_valid and len(value) and not value.values.null_count:
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top
                unit = (x / np.sqrt(x @ x)).tobytes()
        out.append(unit)
    return out


def prepare(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, unit): key is null for vectors that cannot link."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            keys = [u and hashlib.blake2b(u, digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "key", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    return rows.mapInArrow(make, "vec_id long, key binary, unit binary")


def _matrix(column) -> np.ndarray:
    units = column.to_pylist()
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1) if units else np.zeros((0, 1))


def _rows(points: DataFrame, most: int) -> int:
    """At most so many points that their vectors have SAMPLE_BYTES together."""
    widest = points.agg(F.max(F.octet_length("unit")).alias("n")).collect()[0]["n"] or 8
    return max(1, min(most, SAMPLE_BYTES // widest))


def centroids(points: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By vector length in bytes: k-means centroids of a sample of at most SAMPLE points."""
    sample = points.orderBy(F.xxhash64("id"), "id").limit(_rows(points, SAMPLE)).select("unit").toArrow().column("unit").to_pylist()
    out = {}
    for size in sorted({len(u) for u in sample}):
        x = np.frombuffer(b"".join(u for u in sample if len(u) == size), np.float64).reshape(-1, size // 8)
        k = int(min(max(1, round(n * len(x) / max(len(sample), 1) / CLUSTER)), MOST_CLUSTERS, len(x)))
        c = x[np.random.Generator(np.random.PCG64(3)).permutation(len(x))[:k]].copy()
        for _ in range(6):
            nearest = np.argmax(x @ c.T, 1)
            for i in range(k):
                mine = x[nearest == i]
                if len(mine):
                    c[i] = mine.mean(0)
                    c[i] /= np.linalg.norm(c[i]) or 1
        out[size] = c
    return out


def clustered(points: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(id, unit, size, cluster): a row for each of a point's ``overlap`` nearest clusters."""
    shared = points.sparkSession.sparkContext.broadcast(centres)  # MOST_CLUSTERS rows a length at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(u) for u in batch.column("unit").to_pylist()])
            for size in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == size))
                centre = shared.value.get(size, np.zeros((1, size // 8)))
                near = np.argsort(-(_matrix(rows.column("unit")) @ centre.T), 1, kind="stable")[:, :overlap]
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                taken = rows.take(at)
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("unit"), pa.array(np.full(near.size, size), pa.int32()), pa.array(near.ravel(), pa.int32())], ["id", "unit", "size", "cluster"])

    return points.select("id", "unit").mapInArrow(assign, "id long, unit binary, size int, cluster int")


def _top(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` rows of y of highest product with each row of x, best first, in blocks."""
    index, value = [], []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ y.T
        part = np.argpartition(-s, n - 1, 1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape).copy()
        v = np.take_along_axis(s, part, 1)
        order = np.argsort(-v, 1, kind="stable")
        index.append(np.take_along_axis(part, order, 1))
        value.append(np.take_along_axis(v, order, 1))
    return np.concatenate(index), np.concatenate(value)


def pruned_neighbours(x: np.ndarray) -> np.ndarray:
    """(points, DEGREE) robust-pruned neighbours in x, -1 where there are fewer."""
    n = min(NEAREST + 1, len(x))
    near, cos = _top(x, x, n)
    cos = np.where(near == np.arange(len(x))[:, None], -2, cos)
    alive = cos > -2
    out = np.full((len(x), DEGREE), -1)
    distance = np.sqrt(np.maximum(2 - 2 * cos, 0))
    for turn in range(DEGREE):
        has = np.flatnonzero(alive.any(1))
        if not len(has):
            break
        first = alive[has].argmax(1)
        chosen = near[has, first]
        out[has, turn] = chosen
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", x[chosen], x[near[has]]), 0))
        alive[has] &= ALPHA * between > distance[has]
        alive[has, first] = False
    return out


def _build(table: pa.Table) -> pa.Table:
    ids, x = table.column("id").to_numpy(), _matrix(table.column("unit")).astype(np.float32)
    edges = pruned_neighbours(x)
    keep = edges >= 0
    source, target = ids[np.nonzero(keep)[0]], ids[edges[keep]]
    both = pa.Table.from_arrays([pa.array(np.concatenate([source, target])), pa.array(np.concatenate([target, source]))], ["id", "next"])
    return both


def range_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and points of cosine SPREAD or more that the search reaches; x, graph: the shard; q: queries."""
    medoid = int(np.argmax(x @ x.mean(0)))
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x) + 1), bool)
    seen[:, -1] = True  # the index -1: no neighbour
    beam, score = np.full((len(q), BEAM), -1), np.full((len(q), BEAM), -2, np.float32)
    done = np.ones((len(q), BEAM), bool)
    beam[:, 0], score[:, 0], done[:, 0], seen[:, medoid] = medoid, q @ x[medoid], False, True
    while True:
        open_score = np.where(done, -3, score)
        best = open_score.argmax(1)
        go = open_score[rows, best] > -3
        if not go.any():
            break
        at = rows[go]
        done[at, best[go]] = True
        near = graph[beam[at, best[go]]]
        fresh = ~seen[at[:, None], near]
        seen[at[:, None], near] = True
        value = np.where(fresh, np.einsum("nd,nkd->nk", q[at], x[near]), -2).astype(np.float32)
        together = np.concatenate([score[at], value], 1)
        order = np.argsort(-together, 1, kind="stable")[:, :BEAM]
        score[at] = np.take_along_axis(together, order, 1)
        beam[at] = np.take_along_axis(np.concatenate([beam[at], near], 1), order, 1)
        done[at] = np.take_along_axis(np.concatenate([done[at], ~fresh], 1), order, 1)
    hit = score >= SPREAD
    query, point = np.nonzero(hit)[0], beam[hit]
    reached = np.zeros((len(q), len(x)), bool)
    reached[query, point] = True
    while len(query):
        found = []
        for i in range(0, len(query), FRONTIER):
            near = graph[point[i : i + FRONTIER]]
            source, near = np.repeat(query[i : i + FRONTIER], near.shape[1]), near.ravel()
            good = near >= 0
            source, near = source[good], near[good]
            pair = np.unique(source[~reached[source, near]] * np.int64(len(x)) + near[~reached[source, near]])
            source, near = pair // len(x), pair % len(x)
            close = np.concatenate([np.einsum("nd,nd->n", q[source[j : j + 65536]], x[near[j : j + 65536]]) for j in range(0, len(source), 65536)] or [np.zeros(0)]) >= SPREAD
            reached[source[close], near[close]] = True
            found.append((source[close], near[close]))
        query, point = (np.concatenate(part) for part in zip(*found, strict=True))
    return np.nonzero(reached)


def _search(members: pa.Table, edges: pa.Table) -> pa.Table:
    names, kinds = ["a", "b"], [pa.int64(), pa.int64()]
    empty = pa.Table.from_batches([record_batch([], names, kinds)])
    own = members.filter(members.column("own")) if len(members) else members
    if not len(own):
        return empty
    order = np.argsort(own.column("id").to_numpy(), kind="stable")
    ids, exact = own.column("id").to_numpy()[order], _matrix(own.column("unit"))[order]
    x = exact.astype(np.float32)
    source, target = edges.column("node").to_numpy(), edges.column("next").to_numpy()
    at, to = np.searchsorted(ids, source), np.minimum(np.searchsorted(ids, target), len(ids) - 1)
    inside = ids[to] == target
    at, to = at[inside], to[inside]
    pair = np.unique(at * np.int64(len(ids)) + to)
    at, to = pair // len(ids), pair % len(ids)
    first = np.searchsorted(at, np.arange(len(ids) + 1))
    graph = np.full((len(ids), max(1, int(np.diff(first).max(initial=0)))), -1)
    graph[at, np.arange(len(at)) - first[at]] = to
    query_ids, queries = members.column("id").to_numpy(), _matrix(members.column("unit"))
    # a pair is one number: of two own points by their places, else by the query's place after those
    n, where = len(ids), np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    mine, found = ids[where] == query_ids, [np.zeros(0, np.int64)]
    for i in range(0, len(query_ids), QUERIES):
        q, p = range_search(x, graph, queries[i : i + QUERIES].astype(np.float32))
        for j in range(0, len(q), 65536):
            a, b = q[j : j + 65536] + i, p[j : j + 65536]
            link = (np.einsum("nd,nd->n", queries[a], exact[b]) >= COSINE) & (query_ids[a] != ids[b])
            a, b = a[link], b[link]
            found.append(np.where(mine[a], np.minimum(where[a], b) * n + np.maximum(where[a], b), n * n + a * n + b))
    pairs = np.unique(np.concatenate(found))
    del found
    inner, outer = pairs[pairs < n * n], pairs[pairs >= n * n] - n * n
    left, right = np.concatenate([ids[inner // n], query_ids[outer // n]]), ids[np.concatenate([inner % n, outer % n])]
    return pa.Table.from_arrays([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())], names)


def _links(scratch: Scratch, points: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    rows = clustered(points, centres, overlap)
    counts = rows.groupBy("size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch.cut(rows.join(counts, ["size", "cluster"]).withColumn("parts", F.ceil(F.col("n") / SHARD).cast("int")))
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    shards = rows.withColumn("part", mine)
    edges = scratch.cut(shards.groupBy("size", "cluster", "part").applyInArrow(_build, "id long, next long").distinct())
    # a point's united list goes to each of its shards; it is a query in every part of its clusters
    lists = shards.select(F.col("size").alias("s"), F.col("cluster").alias("c"), F.col("part").alias("p"), F.col("id").alias("node")).join(edges.withColumnRenamed("id", "node"), "node")
    visits = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).withColumn("own", F.col("part") == mine)
    found = visits.groupBy("size", "cluster", "part").cogroup(lists.groupBy("s", "c", "p")).applyInArrow(_search, "a long, b long")
    return scratch.cut(found.distinct())


def audited_recall(scratch: Scratch, points: DataFrame, links: DataFrame) -> float:
    """The lower of two recalls of AUDIT points (by hash): of sparse points and of dense ones; brute force in blocks.

    Each is the mean, over the points that have links, of the share of a point's true links that is in ``links``.
    """
    chosen = points.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(_rows(points, AUDIT)).select("id", "unit").toArrow()
    shared = points.sparkSession.sparkContext.broadcast((chosen.column("id").to_numpy(), chosen.column("unit").to_pylist()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        for batch in batches:
            for size in {len(u) for u in units}:
                mine = np.array([len(u) == size for u in units])
                rows = batch.filter(pa.array([len(u) == size for u in batch.column("unit").to_pylist()], pa.bool_()))
                if not len(rows):
                    continue
                q = np.frombuffer(b"".join(u for u in units if len(u) == size), np.float64).reshape(-1, size // 8)
                a, b = np.nonzero(q @ _matrix(rows.column("unit")).T >= COSINE)
                a, b = ids[mine][a], rows.column("id").to_numpy()[b]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    true = points.select("id", "unit").mapInArrow(compare, "a long, b long").distinct()
    told = scratch.cut(true.join(links.select("a", "b").withColumn("hit", F.lit(1.0)), ["a", "b"], "left").fillna(0.0, ["hit"]))
    ends = told.select(F.explode(F.array("a", "b")).alias("id"), "hit").where(F.col("id").isin(chosen.column("id").to_pylist()))
    shares = ends.groupBy("id").agg(F.avg("hit").alias("share"), F.count(F.lit(1)).alias("n"))
    rows = shares.groupBy((F.col("n") <= SPARSE).alias("sparse")).agg(F.avg("share").alias("recall")).collect()
    return min([r["recall"] for r in rows], default=1.0)


def exact_links(scratch: Scratch, points: DataFrame) -> DataFrame:
    """All links (a, b), by comparing every two blocks of points."""
    blocks = max(1, -(-points.count() // EXACT_ROWS))
    dealt = points.select("id", "unit", F.octet_length("unit").alias("size"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).cast("int").alias("block"))
    meets = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = dealt.withColumn("with", meets).select("id", "unit", "size", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, x, block = table.column("id").to_numpy(), _matrix(table.column("unit")), table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two, found = np.flatnonzero(block == i), np.flatnonzero(block == j), []
        for low in range(0, len(one), 512):
            part = one[low : low + 512]
            a, b = np.nonzero(x[part] @ x[two].T >= COSINE)
            a, b = ids[part[a]], ids[two[b]]
            keep = a < b if i == j else a != b
            found.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return scratch.cut(rows.groupBy("size", "i", "j").applyInArrow(compare, "a long, b long"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``vectors`` (vec_id, embedding)."""
    with tidy(vectors.sparkSession), Scratch(vectors.sparkSession) as scratch:
        ready = cut(prepare(vectors))
        known = ready.where("key is not null").select("vec_id", "key").distinct()
        classes = scratch.cut(known.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
        points = scratch.cut(ready.where("key is not null").select("key", F.col("vec_id").alias("id"), "unit").join(classes.select("key", "id"), ["key", "id"], "left_semi").dropDuplicates(["key", "id"]))
        centres = centroids(points, points.count())
        overlap, recall = 2, 0.0
        while True:
            links = _links(scratch, points, centres, overlap)
            recall = audited_recall(scratch, points, links)
            if recall >= RECALL:
                break
            overlap *= 2
            if overlap > MOST_OVERLAP:
                links, recall = exact_links(scratch, points), 1.0
                break
        groups = components(links, scratch)
        copies = classes.select(F.col("id").alias("b"), "copies")
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("linked"))
        told = classes.join(degree, F.col("id") == F.col("a"), "left").join(groups, F.col("id") == F.col("node"), "left")
        told = cut(told.select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = ready.select("vec_id", "key").join(told, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(recall).alias("recall"))
