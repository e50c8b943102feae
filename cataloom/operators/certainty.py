"""The certainty rule: which of some offers a wanted record is, or none.

An offer is named only if the evidence leaves nothing else. Evidence narrows in steps, each only among what the one before it left:
offers of a better catalogue, those that carry the title on stronger grounds, those released in the year (first releases before
re-releases), those of a year beside it, and those a few years off, which only the running time can vouch for. Where several
are left the running time decides, by three values: it agrees, it does not, or one side does not say. One offer has to agree and
none may be unmeasured, since a length that is not known rules nothing out.

The steps are the digits of one rank. Offers are counted by (record, rank), which merges before the shuffle, and a record's least rank is
taken from those counts, so a title that very many offers carry is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tolerance of a running time, in seconds and as a share of the stated one; years beside and around a year.
TOLERANCE_SECONDS, TOLERANCE_SHARE = 300.0, 0.07
NEAR_YEARS, FAR_YEARS = 1, 3

YEAR, LENGTH = "year", "length"


def running_time_agrees(seconds: Column, minutes: Column) -> Column:
    """Whether a file of ``seconds`` is a film of ``minutes``; null if either is not known."""
    stated = minutes * 60.0
    agrees = F.abs(seconds - stated) <= F.greatest(F.lit(TOLERANCE_SECONDS), stated * TOLERANCE_SHARE)
    return F.when((seconds > 0) & (minutes > 0), agrees)


def _some(names: Column, of: str) -> Column:
    return F.coalesce(F.arrays_overlap(names, F.col(of)), F.lit(False))


def _evidence() -> Column:
    """0 for a title that leads, 1 for one of the offer's own, 2 for any as it is written, 3 for one that only a reading makes."""
    return F.when(_some(F.col("lead"), "plain"), 0).when(_some(F.col("own"), "plain"), 1).when(_some(F.col("spelled"), "plain"), 2).otherwise(3)


def _when() -> Column:
    """0 first released about the year, 1 released in it, 2 beside it, 3 some years off, 4 no year wanted, 9 anything else."""
    within = lambda n: F.coalesce(F.exists("years", lambda y: F.abs(y - F.col("year")) <= n), F.lit(False))
    first = F.coalesce(F.abs(F.array_min("years") - F.col("year")) <= NEAR_YEARS, F.lit(False))
    return F.when(F.col("year").isNull(), 4).when(within(0) & first, 0).when(within(0), 1).when(within(NEAR_YEARS), 2).when(within(FAR_YEARS), 3).otherwise(9)


def certain(wanted: DataFrame, offered: DataFrame, verify: bool = False) -> DataFrame:
    """(id, pick, how) for every wanted id: the offer that it certainly is and what told, or nulls.

    wanted: id, keys (readings of the title), plain (its folds), year, seconds, written (the year the file was made, or null).
    offered: offer, keys, lead, own, spelled (folds of its main titles, its own titles, all its titles), years, minutes, catalogued.
    With ``verify`` a length that disagrees also refuses an only offer of the year. Rows of one id or one offer are one record.
    """
    left, right = (side.withColumn("key", F.explode("keys")).drop("keys") for side in (wanted, offered))
    # by sorting: estimates by the size of a file are too small for what its rows become, and a broadcast would be all of one side
    met = left.hint("merge").join(right, "key")
    met = met.where(F.col("written").isNull() | (F.coalesce(F.size("years"), F.lit(0)) <= 0) | (F.array_min("years") <= F.col("written")))
    # names and years become numbers before pairs are counted once, so that pairs of any number are hashed in fixed width
    rank = (~F.coalesce("catalogued", F.lit(False))).cast("int") * 100 + _evidence() * 10 + _when()
    agrees = running_time_agrees(F.col("seconds"), F.col("minutes"))
    told = met.select("id", "offer", rank.alias("rank"), agrees.alias("agrees"), (F.size("years") > 0).alias("dated")).dropDuplicates(["id", "offer"])
    counted = told.groupBy("id", "rank").agg(
        F.count("*").alias("n"), F.count_if("agrees").alias("fits"), F.count_if(F.col("agrees").isNull()).alias("unmeasured"),
        F.min("offer").alias("only"), F.min(F.when(F.col("agrees") & F.col("dated"), F.col("offer"))).alias("fit"),
        F.min("agrees").alias("agrees"),
    )
    best = counted.groupBy("id").agg(F.min_by(F.struct("*"), "rank").alias("b")).select("b.*")
    when = F.col("rank") % 10
    dated = when <= 1
    refused = F.lit(verify) & F.coalesce(~F.col("agrees"), F.lit(False))
    alone = dated & (F.col("n") == 1)
    by_length = ~alone & (when < 9) & (F.col("fits") == 1) & (F.col("unmeasured") == 0)
    pick = F.when(alone & ~refused, F.col("only")).when(by_length, F.col("fit"))
    how = F.when(pick.isNotNull(), F.when(alone, YEAR).otherwise(LENGTH))
    return wanted.select("id").distinct().join(best.select("id", pick.alias("pick"), how.alias("how")), "id", "left")
