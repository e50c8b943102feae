"""Two-sided planning: upserts, deltas, pending state, best copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(known: DataFrame, new: DataFrame, key: str, days: str, rating: str) -> DataFrame:
    """Known rows gain the new rows' days and rating (the new one wins where it has one); unmatched rows are added.

    Several new rows of one key are gathered first, so the order of arrival does not matter.
    """
    gathered = new.groupBy(key).agg(F.flatten(F.collect_list(days)).alias("new_days"), F.max(rating).alias("new_rating"))
    joined = known.join(gathered, key, "full")
    empty = F.array().cast(known.schema[days].dataType)
    merged = F.array_sort(F.array_union(F.coalesce(days, empty), F.coalesce("new_days", empty)))
    return joined.select(key, merged.alias(days), F.coalesce("new_rating", rating).alias(rating), *[c for c in known.columns if c not in (key, days, rating)])


def enriched(rows: DataFrame, ids: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Missing ``column`` values filled in from exact matches."""
    other = ids.select(*on, F.col(column).alias("__found"))
    return rows.join(other, list(on), "left").withColumn(column, F.coalesce(column, "__found")).drop("__found")


def pending(sent: DataFrame, present: DataFrame, key: str, sent_at: str, exported_at: Column) -> DataFrame:
    """(…, state): confirmed where the other side has it, offer again where a later export lacks it, else wait."""
    seen = present.select(key).distinct().withColumn("__seen", F.lit(True))
    state = F.when(F.col("__seen"), "confirmed").when(F.col(sent_at) < exported_at, "offer").otherwise("wait")
    return sent.join(seen, key, "left").withColumn("state", state).drop("__seen")


def not_in_any(rows: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    for other in others:
        rows = rows.join(other.select(key), key, "left_anti")
    return rows


def rewatches(plays: DataFrame, key: str, day: str, known: str | None = None) -> DataFrame:
    """Adds whether a play has an earlier one, or an earlier day that is ``known`` from elsewhere."""
    again = F.row_number().over(Window.partitionBy(key).orderBy(day)) > 1
    if known is not None:
        again = again | F.coalesce(F.col(known) < F.col(day), F.lit(False))
    return plays.withColumn("rewatch", again)


def best_per_key(rows: DataFrame, key: Sequence[str], value: str, order: Column) -> DataFrame:
    """(key, value) of the row that ``order`` puts highest."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def compared(left: DataFrame, right: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """Best score of each key on both sides, and which side is better."""
    a = left.groupBy(*key).agg(F.max(score).alias("left_best"))
    b = right.groupBy(*key).agg(F.max(score).alias("right_best"))
    better = F.when(F.col("left_best").isNull(), "right").when(F.col("right_best").isNull(), "left").when(F.col("left_best") > F.col("right_best"), "left").when(F.col("left_best") < F.col("right_best"), "right").otherwise("equal")
    return a.join(b, list(key), "full").withColumn("better", better)


def duplicates(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, folders) of keys in more than one separate folder; a folder inside another of the same key is not separate."""
    folders = rows.select(key, folder).distinct()
    parts = F.split(F.col(folder), "/")
    outer = folders.select(key, folder, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("outer"))
    inside = outer.where(F.col("outer") != F.col(folder)).join(folders.withColumnRenamed(folder, "outer"), [key, "outer"], "left_semi").select(key, folder)
    return folders.join(inside, [key, folder], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("folders")).where("folders > 1")
