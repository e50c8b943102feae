"""What is missing from numbered, dated and episodic runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# When a group is a run at all, and what is conspicuous in it.
COVERAGE, DENSITY, DENSE_COUNT, DATES = 0.5, 0.75, 3, 4
CADENCES = ((2, "daily", 7), (10, "weekly", 30), (45, "monthly", 75))
EPISODE = r"(?<![A-Za-z0-9])[Ss]([0-9]{1,3})[ ._,-]*[Ee]([0-9]{1,4})((?:[ ._]*-?[ ._]*[Ee][0-9]{1,4})*)(?![0-9])"
CROSS_EPISODE = r"(?<![A-Za-z0-9])([0-9]{1,2})[xX]([0-9]{2,3})(?![0-9])"
NAMES_SEASON = r"(?i)(?<![A-Za-z0-9])(?:season|series|staffel|saison|seizoen|temporada|stagione|s)[ ._-]*[0-9]{1,3}(?![0-9])"
DATE_PREFIX = r"^([12][0-9]{3})[-._ ]?([01][0-9])[-._ ]?([0-3][0-9])(?![0-9])"


def missing_numbers(rows: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """(group, number) of the holes in each group's numbers, below its highest.

    Groups of one number, and groups too thin for either threshold, have none. Counting begins at 1, for dense groups of years or of
    one disc (101, 102, ...) at the lowest number. Spark makes the numbers per group and takes away those that are there.
    """
    present = rows.where(F.col(number) > 0).select(*group, F.col(number).cast("bigint").alias(number)).distinct()
    runs = present.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))
    years = (F.col("low") >= 1900) & (F.col("high") <= 2099)
    disc = (F.col("low") > 100) & (F.col("low") % 100 == 1) & (F.floor(F.col("low") / 100) == F.floor(F.col("high") / 100))
    covered = F.col("n") / F.col("high") >= COVERAGE
    dense = (F.col("n") >= DENSE_COUNT) & (F.col("n") / (F.col("high") - F.col("low") + 1) >= DENSITY)
    start = F.when(covered, F.lit(1)).when(dense & (years | disc), F.col("low")).when(dense, F.lit(1)).cast("bigint")
    runs = runs.where("n >= 2").withColumn("start", start).where("start is not null and start < high")
    expected = runs.select(*group, F.explode(F.sequence("start", F.col("high") - 1)).alias(number))
    return expected.join(present, [*group, number], "left_anti")


def islands(rows: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """(group, first, last) of each stretch of consecutive numbers."""
    present = rows.select(*group, F.col(number).alias("v")).distinct()
    order = F.row_number().over(Window.partitionBy(*group).orderBy("v"))
    return present.withColumn("island", F.col("v") - order).groupBy(*group, "island").agg(F.min("v").alias("first"), F.max("v").alias("last")).drop("island")


def cadence_gaps(rows: DataFrame, group: Sequence[str], day: str) -> DataFrame:
    """(group, first, last, days, cadence): stretches with nothing in them that are long for how often a run comes."""
    days = rows.select(*group, F.col(day).cast("date").alias("d")).where("d is not null").distinct()
    gaps = days.withColumn("before", F.lag("d").over(Window.partitionBy(*group).orderBy("d"))).where("before is not null")
    gaps = gaps.withColumn("step", F.datediff("d", "before"))
    usual = gaps.groupBy(*group).agg(F.median("step").alias("usual"), F.count(F.lit(1)).alias("steps")).where(F.col("steps") >= DATES - 1)
    label, most = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for slowest, name, conspicuous in CADENCES:
        label, most = label.when(F.col("usual") <= slowest, name), most.when(F.col("usual") <= slowest, conspicuous)
    label = label.otherwise(F.format_string("every %d days or so", F.rint("usual").cast("int")))
    most = most.otherwise(F.floor(F.col("usual") * 2))
    joined = gaps.join(usual.withColumns({"cadence": label, "most": most}), list(group))
    found = joined.where(F.col("step") - 1 >= F.col("most"))
    return found.select(*group, F.date_add("before", 1).alias("first"), F.date_sub("d", 1).alias("last"), (F.col("step") - 1).alias("days"), "cadence")


def episodes(name: Column) -> Column:
    """Array of (season, episode) that a name holds: S01E02, ranges with a dash, several in a row, 1x05."""
    season = F.regexp_extract(name, EPISODE, 1).try_cast("int")
    first = F.regexp_extract(name, EPISODE, 2).try_cast("int")
    more = F.regexp_extract_all(F.regexp_extract(name, EPISODE, 3), F.lit(r"(-?[ ._]*[Ee][0-9]{1,4})"), F.lit(1))
    item = lambda s, e: F.struct(s.alias("season"), e.alias("episode"))

    def step(state: Column, part: Column) -> Column:
        number = F.regexp_extract(part, r"([0-9]+)", 1).cast("int")
        ranged = part.startswith("-") & (number > state["last"])
        added = F.when(ranged, F.sequence(state["last"] + 1, F.greatest(number, state["last"] + 1))).otherwise(F.array(number))
        return F.struct(F.concat(state["all"], added).alias("all"), number.alias("last"))

    listed = F.aggregate(more, F.struct(F.array(first).alias("all"), first.alias("last")), step)["all"]
    cross = [F.regexp_extract(name, CROSS_EPISODE, i).try_cast("int") for i in (1, 2)]
    empty = F.array().cast("array<struct<season:int,episode:int>>")
    return F.when(season.isNotNull(), F.transform(listed, lambda e: item(season, e))).when(cross[0].isNotNull(), F.array(item(*cross))).otherwise(empty)


def episode_gaps(names: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """(folder, season, episode) that is missing; episode is null where a whole season is.

    A folder holds episodes if at least half of its names are some, and two of them where it has several names. Seasons before its
    lowest are missing too, unless the folder's own name says which season it is.
    """
    marked = names.select(F.col(folder).alias("f"), episodes(F.col(name)).alias("all"))
    counts = marked.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("all") > 0).alias("hits"))
    shows = counts.where((F.col("hits") > 0) & (F.col("hits") >= F.least(F.lit(2), F.col("n"))) & (F.col("hits") * 2 >= F.col("n"))).select("f")
    found = marked.join(shows, "f").select("f", F.explode("all").alias("e")).select("f", "e.season", "e.episode").distinct()
    last = found.groupBy("f", "season").agg(F.max("episode").alias("high")).where("high > 1")
    inner = last.select("f", "season", F.explode(F.sequence(F.lit(1), F.col("high") - 1)).alias("episode")).join(found, ["f", "season", "episode"], "left_anti")
    seasons = found.where("season > 0").select("f", "season").distinct()
    one = F.substring_index("f", "/", -1).rlike(NAMES_SEASON)
    ends = seasons.groupBy("f").agg(F.min("season").alias("low"), F.max("season").alias("high")).withColumn("first", F.when(one, F.col("low")).otherwise(1)).where("first < high")
    whole = ends.select("f", F.explode(F.sequence("first", F.col("high") - 1)).alias("season")).join(seasons, ["f", "season"], "left_anti")
    return inner.unionByName(whole.withColumn("episode", F.lit(None).cast("int"))).withColumnRenamed("f", folder)


def date_prefix(name: Column) -> Column:
    """The calendar day that a name leads with, else null."""
    return F.try_to_date(F.nullif(F.concat(*[F.regexp_extract(name, DATE_PREFIX, i) for i in (1, 2, 3)]), F.lit("")), "yyyyMMdd")


def number_range(prefix: Column) -> Column:
    """Numbers of a prefix such as 07 or 01-03; a range of 100 or more is no range."""
    low, high = (F.regexp_extract(prefix, r"^([0-9]+)(?:-([0-9]+))?$", i).try_cast("bigint") for i in (1, 2))
    ranged = (high >= low) & (high - low < 100)
    return F.when(ranged, F.sequence(low, F.greatest(high, low))).when(low.isNotNull() & high.isNull(), F.array(low)).otherwise(F.array().cast("array<bigint>"))
