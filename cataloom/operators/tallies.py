"""Sums that merge, groups of copies, common crops, midpoints, and bounded choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sides are cropped to even numbers, bands thinner than this stay.
CROP_ROUND, LEAST_BAND = 2, 8


def tally(rows: DataFrame, group: Sequence[str], seconds: str, tokens: str, read: str) -> DataFrame:
    """(group, requests, seconds, tokens, counted, counted_seconds, read, rate): six sums that may be merged in any order.

    A request that does not say its tokens counts as a request, and in nothing that is per token; rate is tokens a second.
    """
    told = F.col(tokens).isNotNull()
    sums = {
        "requests": F.count(F.lit(1)),
        "seconds": F.sum(seconds),
        "tokens": F.coalesce(F.sum(tokens), F.lit(0)),
        "counted": F.count(tokens),
        "counted_seconds": F.coalesce(F.sum(F.when(told, F.col(seconds))), F.lit(0.0)),
        "read": F.coalesce(F.sum(F.when(told, F.coalesce(read, F.lit(0)))), F.lit(0)),
    }
    return _rated(rows.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()]))


def merged(tallies: DataFrame, group: Sequence[str]) -> DataFrame:
    """Tallies of parts as one of the whole."""
    names = ("requests", "seconds", "tokens", "counted", "counted_seconds", "read")
    return _rated(tallies.groupBy(*group).agg(*[F.sum(n).alias(n) for n in names]))


def _rated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rate", F.col("tokens") / F.nullif(F.col("counted_seconds"), F.lit(0.0)))


def run_totals(listed: DataFrame, measured: DataFrame, group: Sequence[str], manifest: str, size: str) -> DataFrame:
    """(group, files, bytes) over manifests, line by line: a file that two manifests list counts twice, one without a size counts and adds no bytes.

    A manifest in ``measured`` (group, manifest, size) has the bytes that were measured before its files got other names.
    """
    keys = [*group, manifest]
    each = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("listed"))
    known = measured.groupBy(*keys).agg(F.max(size).alias("measured"))
    each = each.join(known, keys, "left").withColumn("bytes", F.coalesce("measured", "listed", F.lit(0)))
    return each.groupBy(*group).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def copies(films: DataFrame, matched: str, fold: str, year: str) -> DataFrame:
    """Adds ``film``: copies of one film share it, by what they are matched to, else by folded title and year."""
    own = F.concat_ws("|", F.lit("own"), F.coalesce(fold, F.lit("")), F.coalesce(F.col(year).cast("string"), F.lit("")))
    return films.withColumn("film", F.coalesce(F.concat(F.lit("match|"), F.col(matched).cast("string")), own))


def common_crop(rects: DataFrame, group: Sequence[str], x: str, y: str, w: str, h: str, width: str, height: str) -> DataFrame:
    """(group, crop_w, crop_h, crop_x, crop_y) that cuts nothing which any sample of the group kept; groups without a band are left out.

    Each band counts at its smallest over the samples, the two of a pair at the smaller; group and frame size belong together.
    """
    c = F.col
    band = lambda inner: F.greatest(inner, F.lit(0))
    pair = lambda first, size, whole: F.least(band(c(first)), band(c(whole) - c(size) - c(first)))
    bands = rects.groupBy(*group, width, height).agg(F.min(pair(y, h, height)).alias("v"), F.min(pair(x, w, width)).alias("u"))
    thick = lambda n: F.when(c(n) - c(n) % CROP_ROUND < LEAST_BAND, 0).otherwise(c(n) - c(n) % CROP_ROUND)
    bands = bands.withColumns({"v": thick("v"), "u": thick("u")}).where("u > 0 or v > 0")
    out = bands.select(*group, (c(width) - 2 * c("u")).alias("crop_w"), (c(height) - 2 * c("v")).alias("crop_h"), c("u").alias("crop_x"), c("v").alias("crop_y"))
    return out.where("crop_w > 0 and crop_h > 0")


def nearest_cut(frames: DataFrame, group: Sequence[str], time: str, black: str, score: str, target: Column, least_score: float) -> DataFrame:
    """(group, cut, kind): the cut nearest to a target, put midway between its frame and the one before; of equally near ones the first."""
    order = Window.partitionBy(*group).orderBy(time)
    marked = frames.withColumn("before", F.lag(time).over(order)).where(F.col("before").isNotNull() & (F.col(black) | (F.col(score) >= least_score)))
    near = F.struct(F.abs(F.col(time) - target).alias("d"), F.col(time).alias("t"))
    told = F.struct(((F.col("before") + F.col(time)) / 2).alias("cut"), F.when(F.col(black), "black").otherwise("scene").alias("kind"))
    return marked.groupBy(*group).agg(F.min_by(told, near).alias("c")).select(*group, "c.cut", "c.kind")


def bounded(rows: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """Adds ``asked``, true for the first ``most`` of a group (a feature of the search, all rows stay), and ``over``, whether any are left over."""
    by = Window.partitionBy(*group)
    ranked = rows.withColumn("asked", F.row_number().over(by.orderBy(*order)) <= most)
    return ranked.withColumn("over", F.count(F.lit(1)).over(by) > most)


def best_evidence(rows: DataFrame, group: Sequence[str], ranks: Sequence[Column]) -> DataFrame:
    """Of each group the rows that the first rank tells apart keeps, then of those the next, and so on: the least of all ranks together."""
    rank = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)])
    return rows.withColumn("__rank", rank).withColumn("__best", F.min("__rank").over(Window.partitionBy(*group))).where("__rank = __best").drop("__rank", "__best")


def chosen_first(rows: DataFrame, priority: Sequence[Column], position: str, limit: int) -> DataFrame:
    """The ``limit`` rows of highest priority (a cap that is the feature), in the order in which they came."""
    return rows.orderBy(*priority, position).limit(limit).orderBy(position)
