"""Cubes over dimensions that are never null: additive measures, weighted means, and a depth per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "ALL"
#: Axes up to which one CUBE is planned; beyond, rows of the base grain are repeated per mask (see ``cube``).
CUBE_AXES = 6


def base_grain(facts: DataFrame, axes: Sequence[str], sums: Sequence[str] = (), weighted: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row per axis tuple: files, sums, and numerator and denominator of each weighted mean."""
    parts = [F.count(F.lit(1)).alias("files"), *[F.sum(s).alias(s) for s in sums]]
    for name, (value, weight) in (weighted or {}).items():
        both = F.col(value).isNotNull() & F.col(weight).isNotNull()
        parts += [F.sum(F.when(both, F.col(value) * F.col(weight))).alias(f"{name}_num"), F.sum(F.when(both, F.col(weight))).alias(f"{name}_den")]
    return facts.groupBy(*axes).agg(*parts)


# The measures of a viewer's grain by content, as name, column summed and what it is divided by (1 for counts, which stay whole).
GIGABYTE, HOUR, MEGAPIXEL = 1_000_000_000.0, 3_600.0, 1_000_000.0
_SIZE, _TIME = ("sizeGigabytes", "sizeBytes", GIGABYTE), ("durationHours", "durationSeconds", HOUR)
VIEWED = {
    "audio": (_SIZE, _TIME, ("chapters", "chapters", 1)),
    "video": (_SIZE, _TIME, ("chapters", "chapters", 1)),
    "books": (_SIZE, ("pages", "pages", 1), ("words", "words", 1), ("characters", "characters", 1)),
    "images": (_SIZE, ("megapixels", "pixels", MEGAPIXEL)),
    "comics": (_SIZE, ("pages", "pages", 1)),
}


def viewer_grain(facts: DataFrame, content: str, axes: Sequence[str]) -> DataFrame:
    """A row per axis tuple with files and the measures of one content, in the units that a viewer shows."""
    grain = base_grain(facts, axes, [column for _, column, _ in VIEWED[content]])
    shown = [(F.col(column) if unit == 1 else F.col(column) / unit).alias(name) for name, column, unit in VIEWED[content]]
    return grain.select(*axes, "files", *shown)


def mean_of(name: str) -> Column:
    return F.round(F.col(f"{name}_num") / F.nullif(F.col(f"{name}_den"), F.lit(0))).cast("bigint")


def cube(facts: DataFrame, axes: Sequence[str], sums: Sequence[str] = (), weighted: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Every combination of axes, ``ALL`` where an axis is rolled up, and depth, the number that are not.

    The facts are first reduced to their base grain, so only that is multiplied. Up to ``CUBE_AXES`` axes Spark's own CUBE
    does it; a wider one would make an Expand with thousands of projections, so there each row is repeated once
    per mask instead. Grouping is by mask, so a value that is spelled ALL stays apart from the roll-up.
    """
    weighted = weighted or {}
    grain = base_grain(facts, axes, sums, weighted)
    measures = ["files", *sums, *[f"{n}_{p}" for n in weighted for p in ("num", "den")]]
    totals = [F.sum(m).alias(m) for m in measures]
    if len(axes) <= CUBE_AXES:
        rolled = grain.cube(*axes).agg(*totals, F.grouping_id().alias("rolled"))
        shown = [F.when(F.col("rolled").bitwiseAND(1 << (len(axes) - 1 - i)) != 0, ALL).otherwise(F.col(a)).alias(a) for i, a in enumerate(axes)]
        depth = F.lit(len(axes)) - F.bit_count("rolled")
    else:
        masked = grain.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(axes)) - 1))))
        masked = masked.select("mask", *[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(a)).otherwise(ALL).alias(a) for i, a in enumerate(axes)], *measures)
        rolled, shown, depth = masked.groupBy("mask", *axes).agg(*totals), [F.col(a) for a in axes], F.bit_count("mask")
    return rolled.select(*shown, depth.cast("int").alias("depth"), "files", *sums, *[mean_of(n).alias(n) for n in weighted])


def total_row(cubed: DataFrame, axes: Sequence[str] = ()) -> DataFrame:
    """The grand total, read from the cube; ``axes`` given, without those and the depth, which say nothing there."""
    total = cubed.where("depth = 0")
    return total.drop(*axes, "depth") if axes else total


def export_order(cubed: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The order of an export: coarse rows first, then by the axes."""
    return cubed.orderBy("depth", *axes)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
