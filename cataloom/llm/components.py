"""Connected components by random-order contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import Scratch


#: Links that one task may hold (some 40 MB); beyond that, contraction rounds go on.
FEW_LINKS = 250_000


def components(links: DataFrame, scratch: Scratch, few: int = FEW_LINKS, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Distributed union-find: in each round every node points at the neighbour (or itself) that comes first
    in a pseudo-random order of that round, links are rewritten to what their ends point at, and links
    inside one node vanish. A round at least halves the nodes on average whatever the graph's shape, so
    the number of rounds is logarithmic. Minima are taken with partial aggregation and joined back, so
    one node with very many links is never gathered in a task. Once no more than ``few`` links are left,
    one task finishes them. Only counts reach the driver.
    """
    edges = links.select("a", "b").where("a <> b")
    kind = dict(edges.dtypes)["a"]
    steps = []
    for turn in range(max_rounds):
        if edges.count() <= few:
            break
        if not steps:
            edges = scratch.cut(edges.distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), F.col(c).alias("v"))
        step = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = scratch.cut(step.select(F.col("a").alias("node"), F.least("m", order("a"))["v"].alias("to")))
        steps.append(step)
        for side in ("a", "b"):
            edges = edges.join(step.withColumnsRenamed({"node": side, "to": "new"}), side).drop(side).withColumnRenamed("new", side)
        edges = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")
    roots = edges.coalesce(1).mapInPandas(_union_find, f"node {kind}, to {kind}")
    if not steps:
        return scratch.cut(roots.select("node", F.col("to").alias("component")))
    for step in reversed(steps):
        deeper = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = step.join(deeper, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    smallest = roots.groupBy("to").agg(F.min("node").alias("component"))
    return scratch.cut(roots.join(smallest, "to").select("node", F.least("component", "to").alias("component")))


def _union_find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for part in parts:
        for a, b in zip(part["a"], part["b"], strict=True):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "to": [root(x) for x in nodes]})
