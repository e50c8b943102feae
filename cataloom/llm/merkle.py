"""Merkle manifest of a table: a tree of every group of rows, a tree over those, and a proof for each row.

Rows become leaves; leaves of a group stand in order, and every ``FAN`` neighbours become a node until one is left. The groups' roots
form the last tree in the same way. No group, however large, is seen by one task:

* **Places.** Leaves are sorted by ranges over all partitions; counts of each partition and group become offsets.
* **Superblocks.** ``FAN ** depth`` neighbours of a group are reduced by a grouped aggregate to one outer node. Outer nodes are the leaves
  of the next round, until each group has one, so their number falls by 4,096 a round and all rounds are small tables.
* **Subtree exchange.** Downwards, the nodes of a superblock are cogrouped with the one outer node above it, which carries its own
  siblings. One task finishes the local reduction, joins its siblings with the outer ones, and (for leaves) folds.

Defined results: nulls are written as ``-``; rows without the ordering column come first; equal places are ordered by leaf, and equal leaves are
interchangeable; a null group is a group of its own, before all others; an empty table has no rows and no root. Tables live in
the shared folder, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.scratch import Scratch, cut

#: Fixed values of the contract.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one task reduces.
DEPTH = 4


def leaf_of(*values: Column) -> Column:
    """The digest of some values: each as byte count, colon and text, or ``-``."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``pos``, their place among those of equal ``tree`` in the given order.

    Row numbers after a sort by ranges are (partition, row); what is before a partition's rows of a tree is a sum over the partitions before it.
    """
    by = ["tree", *order, "seq"]
    placed = nodes.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("seq")
    placed = scratch.cut(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int")))
    here = placed.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.cut(here.select("part", "tree", (before - F.col("begin")).alias("offset")))
    return placed.join(offsets, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("offset")).drop("at", "part", "offset")


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    size = FAN**depth
    return nodes.withColumn("block", F.shiftright("pos", size.bit_length() - 1)).withColumn("slot", (F.col("pos") % size).cast("int"))


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, digest) of the node over each superblock. The first block of a tree is reduced to one node, if it is the only one; any other ``depth`` times."""
    listed = _blocks(nodes, depth).groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("row"))

    def step(row: Column, _: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / FAN).cast("int"))
        up = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(row, i * FAN + 1, FAN), "").cast("binary"), 256))
        return F.when((F.size(row) > 1) | (F.col("block") > 0), up).otherwise(row)

    digests = F.transform("row", lambda x: x["digest"])
    top = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), digests, step)[0]
    return listed.select("tree", F.col("block").alias("pos"), top.alias("digest"))


def _rounds(nodes: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """``nodes`` and the outer nodes of each round above, up to one of each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("pos").alias("last")).collect()[0]["last"] or 0) > 0:
        rounds.append(scratch.cut(_tops(rounds[-1], depth)))
    return rounds


def _local(digests: list[str], block: int, depth: int) -> list[list[tuple[bytes, bytes]]]:
    """For each level of a superblock, the siblings left and right of each node."""
    out, row = [], [d.encode() for d in digests]
    for _ in range(depth):
        if len(row) == 1 and block == 0:
            break
        sides, up = [], []
        for begin in range(0, len(row), FAN):
            run = row[begin : begin + FAN]
            sides += [(b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run))]
            up.append(hashlib.sha256(b"".join(run)).hexdigest().encode())
        out.append(sides)
        row = up
    return out


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> tuple[pd.DataFrame, list[list[tuple[bytes, bytes]]]]:
    """The nodes of one superblock in order, and for each its siblings of all levels up to the root."""
    nodes = nodes.sort_values("slot")
    levels = _local(nodes["digest"].tolist(), int(outer["block"].iloc[0]), depth)
    above = [(a.encode(), b.encode()) for a, b in zip(outer["lefts"].iloc[0], outer["rights"].iloc[0], strict=True)]
    paths = []
    for i in range(len(nodes)):
        path = []
        for sides in levels:
            path.append(sides[i])
            i //= FAN
        paths.append(path + above)
    return nodes, paths


def _down(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    nodes, paths = _paths(nodes, outer, depth)
    lefts, rights = ([[side[k].decode() for side in path] for path in paths] for k in (0, 1))
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "digest": nodes["digest"], "lefts": lefts, "rights": rights})


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    nodes, paths = _paths(nodes, outer, depth)
    proofs, folded = [], []
    for digest, path in zip(nodes["shown"], paths, strict=True):
        proof, node = hashlib.sha256(), digest.encode()
        for left, right in path:
            proof.update(left + right)
            node = hashlib.sha256(left + node + right).hexdigest().encode()
        proofs.append(proof.hexdigest())
        folded.append(node.decode())
    columns = {"key": nodes["key"], "leaf": nodes["digest"], "subroot": outer["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": folded}
    return pd.DataFrame(columns)


def _exchange(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, digest, lefts, rights) of each node, by its superblock's node in ``above``, which has these columns too."""
    outer = above.withColumnRenamed("pos", "block").drop("digest")
    groups = _blocks(nodes, depth).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return groups.applyInPandas(lambda inner, outer: _down(inner, outer, depth), "tree string, pos long, digest string, lefts array<string>, rights array<string>")


def _descend(rounds: list[DataFrame], top: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """The nodes of the first round but one with their paths; ``top`` is the last round with its paths."""
    for nodes in reversed(rounds[1:-1]):
        top = scratch.cut(_exchange(nodes, top, depth))
    return top


@dataclass
class Manifest:
    """Leaves (tree, pos, digest, key, shown) and the rounds of outer nodes above them; the groups' roots (with their group's name) and the rounds
    above those; and the root (None for no rows)."""

    leaves: list[DataFrame]
    subroots: list[DataFrame]
    root: str | None
    depth: int


def leaves_of(docs: DataFrame, fields: tuple[str, ...], by: str, order: str, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, rank, key, digest, shown) of each row: ``shown`` is the leaf of the row as it is now, with the columns of ``changed`` where ``where`` holds."""
    old, new = {f: f"old_{f}" for f in fields}, {f: f"new_{f}" for f in fields if f in (changed or {})}
    tree = F.when(F.col(by).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(by).cast("string")))
    values = [F.col(f).alias(n) for f, n in old.items()] + [changed[f].alias(n) for f, n in new.items()]
    hit = F.coalesce(F.lit(False) if where is None else where, F.lit(False))
    rows = docs.select(tree.alias("tree"), F.col(order).alias("rank"), *values, hit.alias("hit"))
    rows = rows.withColumn("digest", leaf_of(*[F.col(n) for n in old.values()]))
    shown = F.when(F.col("hit"), leaf_of(*[F.col(new.get(f, old[f])) for f in fields])).otherwise(F.col("digest"))
    return rows.select("tree", "rank", F.col("rank").cast("string").alias("key"), "digest", shown.alias("shown"))


def manifest(rows: DataFrame, scratch: Scratch, depth: int = DEPTH) -> Manifest:
    """The trees over rows of ``leaves_of``, and the tree over their roots."""
    leaves = scratch.cut(rows)  # written before they are sorted, as a sort by ranges reads its input twice
    rounds = _rounds(scratch.cut(_numbered(leaves, ["rank", "digest"], scratch).drop("rank")), depth, scratch)
    names = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = _rounds(scratch.cut(_numbered(names, ["name"], scratch)), depth, scratch)
    last = subroots[-1].select("digest").collect()  # one row
    return Manifest(rounds, subroots, last[0]["digest"] if last else None, depth)


def proofs(trees: Manifest, scratch: Scratch) -> DataFrame:
    """(key, leaf, subroot, proof_sha256, folded_root) of every leaf; the folded root is recomputed from the leaf that the row shows."""
    none, depth = F.array().cast("array<string>"), trees.depth
    top, named = trees.subroots[-1].select("tree", "pos", "digest", none.alias("lefts"), none.alias("rights")), trees.subroots[0]
    if len(trees.subroots) > 1:
        top = _exchange(named, _descend(trees.subroots, top, depth, scratch), depth)
    top = named.select("pos", "name").join(top, "pos")
    top = scratch.cut(top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "lefts", "rights"))
    outer = _descend(trees.leaves, top, depth, scratch).drop("digest").join(top.select("tree", F.col("digest").alias("subroot")), "tree")
    groups = _blocks(trees.leaves[0], depth).groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))
    return groups.applyInPandas(lambda inner, outer: _prove(inner, outer, depth), "key string, leaf string, subroot string, proof_sha256 string, folded_root string")


def audit(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    Leaf, roots and proof are those of the rows as given. The folded root is recomputed from the rows with the columns of ``changed`` where
    ``where`` holds, so a changed row does not verify.
    """
    with Scratch(docs.sparkSession) as scratch:
        trees = manifest(leaves_of(docs, fields, by, order, changed, where), scratch, depth)
        root = F.lit(trees.root).cast("string")
        columns = [F.col("key").cast(docs.schema[order].dataType).alias(order), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root"]
        return cut(proofs(trees, scratch).select(*columns, (F.col("folded_root") == root).alias("verified")))
