"""Intervals and timelines: unions, complements, offsets, remapping, nearest matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(group: Sequence[str], *order: str):
    return Window.partitionBy(*group).orderBy(*order)


def interval_union(rows: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """(group, start, end) of the maximal stretches that the intervals cover; touching ones join, empty ones vanish."""
    kept = rows.where(F.col(end) > F.col(start)).select(*group, F.col(start).alias("start"), F.col(end).alias("end"))
    order = _by(group, "start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = kept.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def wall_clock(rows: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """(group, total): length of the union."""
    return interval_union(rows, group, start, end).groupBy(*group).agg(F.sum(F.col("end") - F.col("start")).alias("total"))


def complement(rows: DataFrame, group: Sequence[str], start: str, end: str, low: Column, high: Column, least=0) -> DataFrame:
    """Stretches of [low, high) that no interval covers and that are longer than ``least``.

    ``low`` and ``high`` are columns over the groups, such as literals or group columns.
    """
    covered = interval_union(rows, group, start, end)
    order = _by(group, "start")
    inner = covered.select(*group, F.coalesce(F.lag("end").over(order), low).alias("a"), F.col("start").alias("b"))
    tail = covered.groupBy(*group).agg(F.max("end").alias("a")).select(*group, "a", high.alias("b"))
    return inner.unionByName(tail).where(F.col("b") - F.col("a") > least).select(*group, F.col("a").alias("start"), F.col("b").alias("end"))


def overlapping_sets(rows: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """(group, overlaps): whether any interval of the whole set starts before an earlier one ends."""
    before = F.max(end).over(_by(group, start, end).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).groupBy(*group).agg(F.coalesce(F.max(F.col(start) < F.col("before")), F.lit(False)).alias("overlaps"))


def cumulative_offset(rows: DataFrame, group: Sequence[str], order: str, length: str, name: str = "offset") -> DataFrame:
    """Each row's start as the sum of the lengths before it."""
    before = _by(group, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))


def remap(marks: DataFrame, kept: DataFrame, group: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Marks moved to a timeline of which only ``kept`` stretches are left; a mark in a cut goes to the next stretch, one behind all is dropped.

    Marks and stretches are sorted together, latest first, so each mark takes the last stretch seen that ends behind it.
    """
    line = cumulative_offset(kept.withColumn("len", F.col(end) - F.col(start)), group, start, "len", "__shift")
    mark = F.struct(*[F.col(c) for c in marks.columns])
    stretch = F.struct(F.col(start).alias("start"), F.col("__shift").alias("shift"))
    one = marks.where(F.col(at).isNotNull()).select(*group, F.col(at).alias("__pos"), F.lit(1).alias("__mark"), mark.alias("__row"))
    two = line.select(*group, F.col(end).alias("__pos"), F.lit(0).alias("__mark"), stretch.alias("__k"))
    both = one.unionByName(two, allowMissingColumns=True)
    order = Window.partitionBy(*group).orderBy(F.desc("__pos"), F.desc("__mark"))
    seen = F.last("__k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__next", seen).where("__mark = 1 and __next is not null")
    return found.select("__row.*", (F.col("__next.shift") + F.greatest(F.col("__pos") - F.col("__next.start"), F.lit(0))).alias("moved"))


def accepted_spans(rows: DataFrame, group: Sequence[str], start: str, end: str, total: str, most_share: float) -> DataFrame:
    """Rows of the groups whose intervals do not overlap and together take at most ``most_share`` of the group's ``total``."""
    sums = rows.groupBy(*group, total).agg(F.sum(F.col(end) - F.col(start)).alias("__sum")).where(F.col("__sum") <= F.col(total) * most_share)
    clear = overlapping_sets(rows, group, start, end).where("not overlaps").select(*group)
    return rows.join(clear, list(group), "left_semi").join(sums.select(*group), list(group), "left_semi")


def split_marks(chapters: DataFrame, kept: DataFrame, group: Sequence[str], start: str, end: str, title: str | None = None, least=0) -> DataFrame:
    """Chapters cut to the kept stretches; the slices of one are numbered, slivers up to ``least`` dropped, later slices' titles marked (cont.)."""
    line = kept.select(*group, F.col(start).alias("k0"), F.col(end).alias("k1"))
    cut = chapters.join(line, list(group)).where((F.col("k0") < F.col(end)) & (F.col(start) < F.col("k1")))
    cut = cut.withColumns({"slice_start": F.greatest(start, "k0"), "slice_end": F.least(end, "k1")}).where(F.col("slice_end") - F.col("slice_start") > least).drop("k0", "k1")
    cut = cut.withColumn("slice", F.row_number().over(_by([*group, start, end], "slice_start")))
    return cut if title is None else cut.withColumn(title, F.when(F.col("slice") > 1, F.concat(title, F.lit(" (cont.)"))).otherwise(F.col(title)))


def rolling_dedupe(rows: DataFrame, group: Sequence[str], order: str, lines: str) -> DataFrame:
    """Lines of a cue that the cue before it did not show."""
    before = F.coalesce(F.lag(lines).over(_by(group, order)), F.array().cast("array<string>"))
    return rows.withColumn(lines, F.array_except(lines, before))


def strictly_increasing(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """(group, increasing) for the whole set."""
    step = rows.withColumn("up", F.col(value) > F.lag(value).over(_by(group, order)))
    return step.groupBy(*group).agg(F.bool_and(F.coalesce("up", F.lit(True))).alias("increasing"))


def nearest(left: DataFrame, right: DataFrame, group: Sequence[str], at: str, to: str, within: float) -> DataFrame:
    """For each left time the nearest right time of the group within ``within``, earlier first on a tie.

    Times are put in bins of that width, so the range join is an equi-join on neighbouring bins.
    """
    bins = lambda c: F.floor(F.col(c) / within)
    counted = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__copies"))  # equal rows are looked up once, and all returned
    probe = counted.withColumn("__bin", F.explode(F.array(bins(at) - 1, bins(at), bins(at) + 1)))
    found = probe.join(right.select(*group, F.col(to).alias("nearest")).withColumn("__bin", bins("nearest")), [*group, "__bin"])
    found = found.where(F.abs(F.col("nearest") - F.col(at)) <= within)
    best = found.groupBy(*left.columns, "__copies").agg(F.min_by("nearest", F.struct(F.abs(F.col("nearest") - F.col(at)), F.col("nearest"))).alias("nearest"))
    return best.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).drop("__copies")


def ordinal(rows: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """1..n in order, and the number at the width of the group's largest."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    width = F.length(F.count(F.lit(1)).over(Window.partitionBy(*group)).cast("string"))
    return rows.withColumn("ordinal", n).withColumn("numbered", F.lpad(F.col("ordinal").cast("string"), width, F.lit("0")))


def head_and_tail(rows: DataFrame, group: Sequence[str], order: str, n: int) -> DataFrame:
    """First n/2 and last n - n/2 rows of each group (a sampling report)."""
    up, down = F.row_number().over(_by(group, order)), F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return rows.withColumns({"up": up, "down": down}).where((F.col("up") <= n // 2) | (F.col("down") <= n - n // 2)).drop("up", "down")


def sequential_cuts(candidates: DataFrame, wholes: DataFrame, group: Sequence[str], at: str, total: str, pieces: str) -> DataFrame:
    """(group, piece, cut) of wholes cut into about ``pieces`` like parts, each cut at the candidate nearest to its place.

    A candidate counts for the place it is within half a part of, unless it lies within a fifth of a part of the cut before (at first, the
    beginning) or of the end; without one the cut stays at its place. A cut up to a second after the last one is left out.

    Each cut depends on the one before it, but not on all candidates: above its place the nearest is always far enough from the last cut,
    and below it, if the nearest is too close, all others are closer. So each place needs two candidates, a maximum and a minimum that merge
    before the shuffle, and the ordered fold runs over the places of a whole, not over its candidates.
    """
    part = F.col(total) / F.col(pieces)
    near = candidates.join(wholes.select(*group, total, pieces), list(group)).where(F.col(pieces) >= 2)
    place = F.floor(F.col(at) / part)
    places = F.array(*[p for p in (place, place + 1)])  # the last place below and the first above
    near = near.where(F.col(at) < F.col(total) - part * 0.2).withColumn("__k", F.explode(places))
    off = F.col(at) - F.col("__k") * part
    near = near.where((F.col("__k") >= 1) & (F.col("__k") < F.col(pieces)) & (F.abs(off) <= part / 2))
    pairs = near.groupBy(*group, "__k").agg(F.max(F.when(off < 0, F.col(at))).alias("below"), F.min(F.when(off >= 0, F.col(at))).alias("above"))
    known = pairs.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(F.col("__k"), F.struct("below", "above")))).alias("__near"))
    rows = wholes.where(F.col(pieces) >= 2).join(known, list(group), "left")
    part = part.cast("double")
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<struct<piece:bigint,cut:double>>").alias("cuts"))

    def step(state: Column, k: Column) -> Column:
        target, found = k * part, F.try_element_at("__near", k)
        below = F.when(found["below"] > state["last"] + part * 0.2, found["below"])
        nearer = F.when(below.isNull() | (found["above"] - target < target - below), found["above"]).otherwise(below)
        best = F.coalesce(nearer, below, target).cast("double")
        more = F.array_append(state["cuts"], F.struct(k.alias("piece"), best.alias("cut")))
        return F.when(best <= state["last"] + 1, state).otherwise(F.struct(best.alias("last"), more.alias("cuts")))

    cuts = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col(pieces).cast("bigint") - 1), start, step)["cuts"]
    return rows.select(*group, F.inline(cuts))
