"""Names of siblings cleaned as a group: what all of them share in front, behind and in the middle is dropped at word boundaries.

A group, one folder's names, may be of any size and is never in one task. Each step is an aggregate that merges before the shuffle:

* What all names begin with is what the least and the greatest of them begin with; ends likewise, by the names read backwards.
* Whether a cut would split a word or a number of some name is a flag over the names.
* A middle passage is made of places at which all names have one character: a least and a greatest character a place, whether all are
  separators, and how far the partners of brackets there lie. Only these rows of a group, as many as its shortest name is long, come
  together, and a small function finds the passages in them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Brackets by pairs, separators as a class of characters (all that is no letter or digit below U+00A0), and characters of the shortest
#: middle passage.
OPENING, CLOSING = "([{<", ")]}>"
SEPARATORS = r"\x00-/:-@\[-`{-\x9f"
SHORTEST_MIDDLE = 3

_LETTER, _DIGIT, _OTHER = "L", "D", "O"


def _kind(char: Column) -> Column:
    """Digits of ASCII, separators, and letters, which is everything else."""
    return F.when(char.rlike("^[0-9]$"), _DIGIT).when(char.rlike(f"^[{SEPARATORS}]$"), _OTHER).otherwise(_LETTER)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _common(a: Column, b: Column) -> Column:
    """What two texts both begin with."""
    x, y = _chars(a), _chars(b)
    differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False).cast("int")
    return F.when(differs == 0, a).otherwise(F.substring(a, F.lit(1), differs - 1))


def _brackets(text: Column) -> Column:
    return F.filter(F.transform(_chars(text), lambda c, i: F.struct(i.cast("int").alias("at"), c.alias("c"))), lambda x: x["c"].isin(*OPENING, *CLOSING))


def bracket_pairs(text: Column) -> Column:
    """(first, last) places of the pairs of a text, by a stack: a closing bracket whose partner is not on top is no pair and changes nothing."""
    empty = F.array().cast("array<struct<at:int,c:string>>"), F.array().cast("array<struct<first:int,last:int>>")
    fits = lambda top, c: F.translate(top, OPENING, CLOSING) == c

    def step(state: Column, x: Column) -> Column:
        top = F.get(state["open"], F.size(state["open"]) - 1)
        pushed = F.struct(F.array_append(state["open"], x).alias("open"), state["pairs"].alias("pairs"))
        pair = F.struct(top["at"].alias("first"), x["at"].alias("last"))
        popped = F.struct(F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1).alias("open"), F.array_append(state["pairs"], pair).alias("pairs"))
        return F.when(x["c"].isin(*OPENING), pushed).when(F.coalesce(fits(top["c"], x["c"]), F.lit(False)), popped).otherwise(state)

    return F.aggregate(_brackets(text), F.struct(empty[0].alias("open"), empty[1].alias("pairs")), step)["pairs"]


def _balanced(text: Column) -> Column:
    return F.size(bracket_pairs(text)) * 2 == F.size(_brackets(text))


def _affixes(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, copies, front, back) of rows (group, low, copies): what all names begin and end with, drawn back to the boundary of a word or number where a cut would split one."""
    back = F.reverse("low")
    ends = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("low").alias("a"), F.max("low").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"))
    ends = ends.select(*group, "n", "copies", _common(F.col("a"), F.col("b")).alias("front"), F.reverse(_common(F.col("c"), F.col("d"))).alias("back"))
    # the last letter of a Roman number that counts is not shared
    ends = ends.withColumn("front", F.regexp_replace("front", " i$", " "))
    size = lambda c: F.length(c)
    after, edge = F.col("low").substr(size("front") + 1, F.lit(1)), F.substring("front", -1, 1)
    before, start = F.col("low").substr(size("low") - size("back"), F.lit(1)), F.substring("back", 1, 1)
    splits = lambda beside, own: (beside != "") & (_kind(own) != _OTHER) & (_kind(beside) == _kind(own))
    met = rows.join(ends, group).groupBy(*group).agg(
        F.bool_or((size("low") > size("front")) & (size("front") > 0) & splits(after, edge)).alias("split_front"),
        F.bool_or((size("low") > size("back")) & (size("back") > 0) & splits(before, start)).alias("split_back"),
    )
    front = F.when(_kind(edge) == _DIGIT, F.regexp_replace("front", "[0-9]+$", "")).otherwise(F.regexp_replace("front", "[A-Za-z]+$", ""))
    back = F.when(_kind(start) == _DIGIT, F.regexp_replace("back", "^[0-9]+", "")).otherwise(F.regexp_replace("back", f"^[^0-9{SEPARATORS}]+", ""))
    both = ends.join(met, group)
    return both.select(*group, "n", "copies", F.when(F.col("split_front"), front).otherwise(F.col("front")).alias("front"), F.when(F.col("split_back"), back).otherwise(F.col("back")).alias("back"))


def middles(same: Sequence[bool], other: Sequence[bool], last: Sequence[int | None], first: Sequence[int | None]) -> str:
    """For each place 0 (stays), 1 (goes) or 2 (becomes a space), from what holds for all names at each place of the shortest one.

    A passage is a run of places where all names agree, within the names, drawn in until both its ends are at separators of every name
    and no bracket in it has its partner outside.
    """
    n, out, at = len(same), ["0"] * len(same), 0
    while at < n:
        if not same[at]:
            at += 1
            continue
        end = at
        while end + 1 < n and same[end + 1]:
            end += 1
        lo, hi, inner = at, end, at >= 1 and end <= n - 2 and end - at + 1 >= SHORTEST_MIDDLE
        moved = inner
        while moved and lo <= hi:
            before = lo, hi
            while lo <= hi and not (other[lo] or other[lo - 1]):
                lo += 1
            while hi >= lo and not (other[hi] or other[hi + 1]):
                hi -= 1
            lo = max([lo, *(p + 1 for p in range(lo, hi + 1) if last[p] is not None and last[p] > hi)])
            hi = min([hi, *(p - 1 for p in range(lo, hi + 1) if first[p] is not None and first[p] < lo)])
            moved = (lo, hi) != before
        if inner and hi - lo + 1 >= SHORTEST_MIDDLE:
            out[lo : hi + 1] = "1" * (hi - lo + 1)
            if (other[lo] or other[hi]) and not other[lo - 1] and not other[hi + 1]:
                out[lo] = "2"
        at = end + 1
    return "".join(out)


@F.pandas_udf(StringType())
def _middles(places: pd.Series) -> pd.Series:
    return pd.Series([middles(*zip(*[(p["same"], p["other"], p["last"], p["first"]) for p in row], strict=True)) if len(row) else "" for row in places])


def clean_siblings(rows: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``clean``: names without what all of their group share, in any case of letters.

    Brackets go in pairs: where those of both ends do not make whole pairs they stay, and where a shared end takes one of a pair, its partner in
    the name goes too. A group of one name is left alone; of several equal names nothing is left. Null names stay null and count for nothing.
    """
    # the group's columns as one, whatever their names; nulls in it are a group too
    rows, group = rows.withColumn("__group", F.struct(*[F.col(f"`{c}`") for c in group])), ["__group"]
    named = rows.where(F.col(name).isNotNull()).groupBy(*group, F.col(name).alias("name")).agg(F.count("*").alias("copies")).withColumn("low", F.lower("name"))
    ends = _affixes(named, group).where("copies > 1")
    marks = lambda c: F.array_join(F.transform(_brackets(F.col(c)), lambda x: x["c"]), "")
    ends = ends.withColumns({"open": marks("front"), "close": marks("back")})
    keep = ~_balanced(F.concat("open", "close"))
    ends = ends.select(*group, "n", "front", "back", F.when(keep, F.col("open")).otherwise("").alias("open"), F.when(keep, F.col("close")).otherwise("").alias("close"), (~keep & (F.concat("open", "close") != "")).alias("orphans"))
    cut = named.select(*group, "name").join(ends, group)
    p, kept = F.length("front"), F.greatest(F.length("name") - F.length("front") - F.length("back"), F.lit(0))
    pairs = bracket_pairs(F.col("name"))
    inside = lambda at: (at >= p) & (at < p + kept)
    lost = F.flatten(F.transform(F.filter(pairs, lambda x: inside(x["first"]) != inside(x["last"])), lambda x: F.array(x["first"], x["last"])))
    middle = F.col("name").substr(p + 1, kept)
    left = F.array_join(F.filter(_chars(middle), lambda c, j: ~F.array_contains("lost", (j + F.col("p")).cast("int"))), "")
    cut = cut.withColumns({"lost": F.when(F.col("orphans"), lost).otherwise(F.array().cast("array<int>")), "p": p})
    cut = cut.withColumn("left", F.concat("open", F.when(F.size("lost") > 0, left).otherwise(middle), "close")).select(*group, "n", "name", "left")
    # places that every name has
    low = cut.select(*group, "n", F.lower("left").alias("low"))
    partner = F.flatten(F.transform(bracket_pairs(F.col("low")), lambda x: F.array(F.struct(x["first"].alias("at"), x["last"].alias("to")), F.struct(x["last"].alias("at"), x["first"].alias("to")))))
    low = low.withColumns({"partner": partner, "c": _chars(F.col("low"))})
    spots = low.select(*group, "n", "partner", F.posexplode("c").alias("at", "c"))
    spots = spots.withColumn("to", F.get(F.filter("partner", lambda x: x["at"] == F.col("at")), F.lit(0))["to"])
    merged = spots.groupBy(*group, "n", "at").agg(F.count("*").alias("names"), (F.min("c") == F.max("c")).alias("same"), F.bool_and(_kind(F.col("c")) == _OTHER).alias("other"), F.max("to").alias("last"), F.min("to").alias("first"))
    found = merged.where("names = n").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "same", "other", "last", "first"))).alias("places")).select(*group, _middles("places").alias("plan"))
    fate = lambda j: F.substring("plan", j + 1, F.lit(1))
    without = F.array_join(F.transform(_chars(F.col("left")), lambda c, j: F.when(fate(j) == "2", " ").when(fate(j) == "1", "").otherwise(c)), "")
    done = cut.join(found, group, "left").select(*group, F.col("name").alias(name), F.when(F.contains("plan", F.lit("1")), without).otherwise(F.col("left")).alias("clean"))
    return rows.join(done, [*group, name], "left").withColumn("clean", F.coalesce("clean", name)).select(*[F.col(f"`{c}`") for c in rows.columns if c not in group], "clean")


#: Fixed value: the form of a day in front of a name.
DAY = "^[12][0-9]{3}([0-9]{4}|-[01][0-9]-[0-3][0-9])$"


def _by_group(rows: DataFrame, group: Sequence[str], told: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` (with __group) joined with what was told of their groups, with some columns changed."""
    kept = [c for c in rows.columns if c != "__group"]
    return rows.join(told, "__group", "left").select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in kept])


def _keyed(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.withColumn("__group", F.struct(*[F.col(f"`{c}`") for c in group]))


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(38,0)"))


def pad_prefixes(rows: DataFrame, group: Sequence[str], prefix: str, core: str) -> DataFrame:
    """Numbers in front of names at the width of their group's largest, if the group's are two or more, all different, without a gap.

    A core that is only its prefix is padded too. The test is by counts: numbers are counted once each before they are counted by group.
    """
    rows = _keyed(rows, group)
    each = rows.select("__group", _number(F.col(prefix)).alias("v")).groupBy("__group", "v").agg(F.count("*").alias("n"))
    runs = each.groupBy("__group").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.max("v").alias("most"), F.min("v").alias("least"), F.count_if(F.col("v").isNull()).alias("other"))
    run = (F.col("other") == 0) & (F.col("n") > 1) & (F.col("values") == F.col("n")) & (F.col("most") - F.col("least") + 1 == F.col("n"))
    told = runs.select("__group", F.when(run, F.length(F.col("most").cast("string"))).alias("__width"))
    value = _number(F.col(prefix)).cast("string")
    padded = F.when(F.col("__width").isNotNull(), F.lpad(value, F.col("__width"), F.lit("0")))
    return _by_group(rows, group, told, {prefix: F.coalesce(padded, F.col(prefix)), core: F.when(F.col(core) == F.col(prefix), F.coalesce(padded, F.col(core))).otherwise(F.col(core))})


def drop_doubled_prefixes(rows: DataFrame, group: Sequence[str], prefix: str, core: str) -> DataFrame:
    """Empties the prefixes of a group whose every core begins with its prefix again, numbers compared by value."""
    rows = _keyed(rows, group)
    lead = F.substring_index(core, " ", 1)
    numbers = _number(F.col(prefix)).isNotNull() & _number(lead).isNotNull()
    again = F.when(numbers, _number(F.col(prefix)) == _number(lead)).otherwise((F.col(core) == F.col(prefix)) | F.startswith(F.col(core), F.concat(prefix, F.lit(" "))))
    told = rows.groupBy("__group").agg(F.bool_and(F.coalesce((F.col(prefix) != "") & again, F.lit(False))).alias("__doubled"))
    return _by_group(rows, group, told, {prefix: F.when(F.col("__doubled"), "").otherwise(F.col(prefix))})


def drop_uniform_prefixes(rows: DataFrame, group: Sequence[str], prefix: str, core: str) -> DataFrame:
    """Empties a prefix that all of a group of two or more have, unless it is a day or some core would leave no name."""
    rows = _keyed(rows, group)
    same = (F.min(prefix) == F.max(prefix)) & (F.count(prefix) == F.count("*")) & (F.count("*") > 1) & (F.min(prefix) != "") & ~F.min(prefix).rlike(DAY)
    told = rows.groupBy("__group").agg((same & F.bool_and(F.coalesce(F.col(core) != "", F.lit(False)))).alias("__uniform"))
    return _by_group(rows, group, told, {prefix: F.when(F.coalesce("__uniform", F.lit(False)), "").otherwise(F.col(prefix))})


def settled_prefixes(rows: DataFrame, group: Sequence[str], prefix: str, core: str) -> DataFrame:
    """Doubled prefixes dropped, then numbers padded, then prefixes dropped that tell nothing apart."""
    return drop_uniform_prefixes(pad_prefixes(drop_doubled_prefixes(rows, group, prefix, core), group, prefix, core), group, prefix, core)
