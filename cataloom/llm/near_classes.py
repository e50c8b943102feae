"""Classes of near duplicates among items with signatures, verified by exact set similarity.

Work grows with the items and not with the pairs: tasks that compare many items return only what connects them.

1. Families. Items that share a band meet in its bucket and are connected where their signatures agree in enough
   places; connected items are a family. Only pairs of one family can be links.
2. Verification. Each family's sets meet in one task, which compares all their pairs and returns enough links to connect
   what is linked. A family too large for one task is first compared with one leader, which settles edited copies of
   one original; then those that are still apart are compared with all of the family, block by block.

Buckets and families of every size are treated by this one rule: beyond ``BLOCK_ROWS`` items (or ``BLOCK_BYTES``) they are
dealt over blocks, and every two blocks meet under a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import textcore as tc
from cataloom.llm.components import components
from cataloom.llm.scratch import Scratch

BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: Items of a group up to which its pairs are listed together with those of other groups.
LISTED = 12
#: Bytes of sets that are compared at a time, columns of a comparison by matrix, pairs of signatures compared at a time.
TOGETHER, COLUMNS, PAIRS = 1 << 19, 2_048, 1 << 16

#: Gives the keys and weights of the sets in a column, and where each set begins; keys of a set are distinct.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def pack_signatures(sig: np.ndarray) -> np.ndarray:
    """(items, places) 16-bit signatures of wider ones: enough to count agreeing places."""
    return (tc.mix(sig.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where each group begins, from rows sorted by integer ``keys``."""
    rest = None
    for batch in batches:
        tc.release()
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = _changes(table, keys)
        if len(at):
            yield table.slice(0, at[-1]).combine_chunks(), np.concatenate([[0], at])
        rest = table.slice(at[-1]) if len(at) else table
    if rest is not None:
        yield rest.combine_chunks(), np.array([0, len(rest)])


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    columns = [table.column(k).to_numpy() for k in keys]
    return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1


def listed_pairs(starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) of all pairs inside groups of at most ``most`` rows, and the numbers of the larger groups."""
    size = np.diff(starts)
    small = np.flatnonzero(size <= most)
    n = size[small]
    row = np.repeat(starts[small] - np.cumsum(n) + n, n) + np.arange(n.sum())
    later = np.repeat(starts[small + 1], n) - row - 1
    a = np.repeat(row, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    return a, b, np.flatnonzero(size > most)


def connected(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that connect what a symmetric matrix of links connects: each row with the first of its component."""
    first = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if first[seed] < 0:
            first[seed], front = seed, np.array([seed])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (first < 0))
                first[front] = seed
    b = np.flatnonzero(first != np.arange(len(first)))
    return first[b], b


def _edges(agree: float):
    """Ids (a, b) of rows (key..., id, sig) that connect those of a group whose signatures agree."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket", "i", "j"]):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(table), -1)
            least = agree * sig.shape[1]
            a, b, large = listed_pairs(starts, LISTED)
            near = [np.zeros(0, bool)] + [(sig[a[i : i + PAIRS]] == sig[b[i : i + PAIRS]]).sum(1) >= least for i in range(0, len(a), PAIRS)]
            near = np.concatenate(near)
            found = [(a[near], b[near])]
            for g in large:
                part = np.ascontiguousarray(sig[starts[g] : starts[g + 1]].T)
                same = np.zeros((part.shape[1], part.shape[1]), np.uint16)
                for place in part:
                    same += place[:, None] == place
                found.append(tuple(x + starts[g] for x in connected(same >= least)))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    return find


def _shared(keys: np.ndarray, weights: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    """Weight that both sets of each of ``n`` pairs have; ``pair`` is the pair of each element."""
    order = tc.grouped_order(pair, keys, n)
    keys, pair = keys[order], pair[order]
    both = np.flatnonzero((keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1]))
    return np.bincount(pair[both], weights[order][both], n)


def _ragged(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the sets in ``rows``, and the sets' sizes."""
    size = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def alike(sets: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the weighted Jaccard similarity of the sets a and b is ``least`` or more, for each pair."""
    keys, weights, first = sets
    total, out = _totals(sets), []
    step = np.concatenate([[0], np.cumsum(first[a + 1] - first[a] + first[b + 1] - first[b])])
    for low, high in tc.slices(step, TOGETHER // 8):
        parts = [_ragged(first, x[low:high]) for x in (a, b)]
        at = np.concatenate([p for p, _ in parts])
        pair = np.concatenate([np.repeat(np.arange(high - low), n) for _, n in parts])
        common = _shared(keys[at], weights[at], pair, high - low)
        whole = total[a[low:high]] + total[b[low:high]] - common
        out.append((common >= least * whole - 1e-9) & (whole > 0))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _totals(sets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    _, weights, first = sets
    sums = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def alike_matrix(sets: tuple[np.ndarray, np.ndarray, np.ndarray], low: int, high: int, least: float) -> np.ndarray:
    """The same for all pairs of the sets ``low`` to ``high``, by products of matrices of the keys that several have."""
    keys, weights, first = sets
    part = slice(first[low], first[high])
    n, row = high - low, np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
    distinct, at, column, count = np.unique(keys[part], return_index=True, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count > 1)
    place = np.full(len(distinct), -1)
    place[several] = np.arange(len(several))
    weight, column = weights[part][at[several]], place[column]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n))
    for begin in range(0, len(several), COLUMNS):
        end = min(begin + COLUMNS, len(several))
        chosen = slice(*np.searchsorted(column, [begin, end]))
        has = np.zeros((n, end - begin))
        has[row[chosen], column[chosen] - begin] = 1
        common += (has * weight[begin:end]) @ has.T
    total = _totals((keys[part], weights[part], first[low : high + 1] - first[low]))
    whole = total[:, None] + total - common
    return (common >= least * whole - 1e-9) & (whole > 0)


def _links(read: Sets, least: float, keys: list[str]):
    """Ids (a, b) of rows (key..., id, body, known) that connect those of a group whose sets are alike.

    Rows of one group with the same ``known`` (not null) are connected already.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            sizes = tc.text_buffer(table.column("body"))[1]
            ids, known = table.column("id").combine_chunks(), np.array(table.column("known").to_numpy(), bool)
            for g, h in tc.slices(sizes[starts], TOGETHER):
                low, high = int(starts[g]), int(starts[h])
                sets = read(table.column("body").slice(low, high - low).combine_chunks())
                own = starts[g : h + 1] - low
                a, b, large = listed_pairs(own, LISTED)
                good = alike(sets, a, b, least)
                found = [(a[good], b[good])]
                for k in large:
                    near = alike_matrix(sets, int(own[k]), int(own[k + 1]), least)
                    old = known[low + own[k] : low + own[k + 1]]
                    near |= old[:, None] & old
                    found.append(tuple(x + own[k] for x in connected(near)))
                a, b = (np.concatenate(x) + low for x in zip(*found, strict=True))
                keep = ~(known[a] & known[b])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep]))], ["a", "b"])

    return find


def _led(read: Sets, least: float):
    """Ids (a, b) of rows (id, body, leader, leading) whose set is alike to the leader's."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tc.release()
            sizes = tc.text_buffer(batch.column("body"))[1] + tc.text_buffer(batch.column("leading"))[1]
            for low, high in tc.slices(sizes, TOGETHER):
                rows, n = batch.slice(low, high - low), high - low
                one, two = read(rows.column("body")), read(rows.column("leading"))
                both = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2][1:] + len(one[0])])
                good = rows.filter(pa.array(alike(both, np.arange(n), n + np.arange(n), least)))
                yield pa.RecordBatch.from_arrays([good.column("id"), good.column("leader")], ["a", "b"])

    return find


def _met(rows: DataFrame, keys: list[str], blocks: str, block: str, asked: str | None = None) -> DataFrame:
    """``rows`` under every pair i < j of their ``blocks``; with ``asked``, only pairs of which i is less than it.

    A pair's group holds both blocks, so that all pairs of rows of the two meet in it; one block is its own pair 0, 0.
    """
    last = F.col(blocks) - 1
    upto = last if asked is None else F.least(last, F.col(asked) - 1)
    here = F.col(block)
    first = F.when((here > 0) & (upto >= 0), F.sequence(F.lit(0), F.least(here - 1, upto))).otherwise(F.array().cast("array<int>"))
    second = F.when((here < last) & (here <= upto), F.sequence(here + 1, last)).otherwise(F.array().cast("array<int>"))
    pairs = F.concat(F.transform(first, lambda i: F.struct(i.alias("i"), here.alias("j"))), F.transform(second, lambda j: F.struct(here.alias("i"), j.alias("j"))))
    pairs = F.when(F.col(blocks) <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)
    return rows.withColumn("__pair", F.explode(pairs)).select(*keys, F.col("__pair.i").alias("i"), F.col("__pair.j").alias("j"), *[c for c in rows.columns if c not in keys])


def _in_groups(rows: DataFrame, keys: list[str], task, kind: str) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(task, f"a {kind}, b {kind}").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_classes(scratch: Scratch, items: DataFrame, find: Callable[[DataFrame], DataFrame], agree: float, read: Sets, least: float, shared: bool = False) -> DataFrame:
    """(node, component) of ``items`` (id, sig, buckets) that are linked to another one.

    ``sig`` holds packed signatures, ``buckets`` the hashes of an item's bands. ``find`` gives the packed sets (id, body) of some
    items (id), which ``read`` unpacks; sets of weighted Jaccard similarity ``least`` or more are linked. ``agree`` is the share of
    equal signature places below which a pair is not looked at. ``shared`` says that ``buckets`` name hardly any band that no other item has:
    then no join takes those away before the signatures go to their buckets.
    """
    kind = dict(items.dtypes)["id"]
    buckets = items.select("id", F.explode("buckets").alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    crowded = None
    if shared:
        placed = items.select("id", "sig", F.explode("buckets").alias("bucket"))
        crowded = scratch.cut(counts.where(F.col("n") > BLOCK_ROWS))
    else:
        placed = scratch.cut(buckets.join(counts.where("n > 1"), "bucket")).join(items.select("id", "sig"), "id")
    if shared and crowded.isEmpty():
        groups = placed.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "sig")
    else:
        placed = placed if crowded is None else placed.join(crowded, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
        dealt = placed.select("bucket", "id", "sig", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        groups = _met(dealt, ["bucket"], "blocks", "block").select("bucket", "i", "j", "id", "sig")
    edges = scratch.cut(_in_groups(groups, ["bucket", "i", "j"], _edges(agree), kind).distinct())
    family = components(edges, scratch).select(F.col("node").alias("id"), F.xxhash64("component").alias("family"))
    family = scratch.cut(family)
    members = scratch.cut(find(family.select("id")).join(family, "id").select("family", "id", "body", F.octet_length("body").alias("bytes")))
    enough = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    large = scratch.cut(members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).where(enough(F.col("rows"), F.col("bytes")) > 1).select("family"))
    few, more = members, []
    if not large.isEmpty():
        few = members.join(large, "family", "left_anti")
        rows = scratch.cut(members.join(large, "family", "left_semi").select("family", "id", "body"))
        more = _large_families(scratch, rows.select("id", "family"), buckets, rows.select("id", "body"), read, least, enough, kind)
    together = _in_groups(few.select("family", "id", "body", F.lit(False).alias("known")), ["family"], _links(read, least, ["family"]), kind)
    for links in more:
        together = together.union(links)
    return components(scratch.cut(together), scratch)


def _large_families(scratch: Scratch, large: DataFrame, buckets: DataFrame, bodies: DataFrame, read: Sets, least: float, enough, kind: str) -> list[DataFrame]:
    """Links of families (id, family) that are more than a task should hold."""
    placed = scratch.cut(buckets.join(large, "id"))
    counts = placed.groupBy("family", "bucket").agg(F.count(F.lit(1)).alias("n"))
    met = placed.join(counts, ["family", "bucket"]).groupBy("family", "id").agg(F.sum("n").alias("met"))
    leaders = met.groupBy("family").agg(F.max_by("id", F.struct("met", F.xxhash64("id").alias("o"))).alias("leader"))
    leading = leaders.join(bodies.select(F.col("id").alias("leader"), F.col("body").alias("leading")), "leader")
    rows = large.join(bodies, "id")
    led = rows.join(leading, "family").where("id <> leader").select("id", "body", "leader", "leading").mapInArrow(_led(read, least), f"a {kind}, b {kind}")
    led = scratch.cut(led)
    settled = led.select(F.col("a").alias("id")).union(led.select(F.col("b").alias("id"))).union(leaders.select(F.col("leader").alias("id"))).distinct()
    marked = large.join(settled.withColumn("known", F.lit(True)), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sized = marked.join(bodies.select("id", F.octet_length("body").alias("bytes")), "id")
    open_rows, open_bytes = F.sum(F.when(~F.col("known"), 1).otherwise(0)), F.sum(F.when(~F.col("known"), F.col("bytes")).otherwise(0))
    sizes = sized.groupBy("family").agg(enough(open_rows, open_bytes).alias("open"), enough(F.count(F.lit(1)) - open_rows, F.sum("bytes") - open_bytes).alias("rest")).where("open > 0")
    # blocks 0 to open - 1 hold the rows that are still apart, the others those that the leader has settled
    block = F.when(F.col("known"), F.col("open") + F.pmod(F.xxhash64("id"), F.greatest("rest", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.greatest("open", F.lit(1)))).cast("int")
    dealt = marked.join(sizes, "family").withColumn("block", block).withColumn("blocks", F.col("open") + F.col("rest"))
    pairs = _met(dealt, ["family"], "blocks", "block", "open").select("family", "i", "j", "id", "known")
    groups = pairs.join(bodies, "id").select("family", "i", "j", "id", "body", "known")
    return [led.select("a", "b"), _in_groups(groups, ["family", "i", "j"], _links(read, least, ["family", "i", "j"]), kind)]
