"""Record linkage by rungs of falling evidence, and two-sided planning on its answers.

Records are (id, title, year, ids): ids are scheme:value texts. Each rung is an equi-join on exploded keys, so the
candidates of a record never meet those of another; the strongest rung that answers at all wins; more than one
answer is ambiguous unless exactly one has the same folded title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.titles import fold, is_latin, near_blocks, one_slip, readings, segments, word_runs
from cataloom.session import spread

ID, SAME_YEAR, NEAR_YEAR, NO_YEAR, PART, SLIP = range(1, 7)


def prepared(records: DataFrame) -> DataFrame:
    """Adds the folded title, its readings and its script."""
    folded = records.withColumn("fold", fold(F.col("title")))
    return folded.withColumns({"keys": readings(F.col("title")), "latin": is_latin(F.col("title"))})


def _led_by(*before: Column):
    """Makes keys of keys, with some columns before each."""
    return lambda keys: F.transform(keys, lambda k: F.concat_ws("|", *before, k))


def _keys(side: str) -> list[tuple[str, Column]]:
    """(tag, keys) of every rung for the prepared records of one side; a tag's keys meet only those of the same tag.

    Years and scripts are part of the keys, so that titles of other years do not meet.
    """
    year, script = F.col("year"), F.col("latin").cast("string")

    def of_year(keys: Column, years: tuple[int, ...] = (0,)) -> Column:
        return F.when(year.isNotNull(), F.flatten(F.array(*[_led_by((year + n).cast("string"), script)(keys) for n in years])))

    whole, keyed = F.array("fold"), _led_by(script)(F.col("keys"))
    parts = F.transform(segments(F.col("title")), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    parts = F.filter(F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1), F.col("fold"))), lambda s: F.length(s) > 3)
    runs, left = word_runs(F.col("fold")), side == "l"
    return [
        ("id", F.col("ids")),
        ("year", of_year(F.col("keys"))),
        ("near", of_year(whole, (-1, 1)) if left else of_year(whole)),
        ("none", F.when(year.isNull(), keyed) if left else keyed),
        ("other", F.when(year.isNotNull(), keyed) if left else F.when(year.isNull(), keyed)),
        ("part", of_year(parts)),
        ("begun", of_year(runs if left else whole)),
        ("within", of_year(whole if left else runs)),
        ("slip", of_year(near_blocks(F.col("fold")))),
    ]


_RUNG_OF = {"id": ID, "year": SAME_YEAR, "near": NEAR_YEAR, "none": NO_YEAR, "other": NO_YEAR, "part": PART, "begun": PART, "within": PART, "slip": SLIP}


def _exploded(records: DataFrame, side: str) -> DataFrame:
    """A row for each key of each rung of a record; the readings are made once for all of them."""
    empty = F.array().cast("array<struct<tag:string,key:string>>")

    def of(tag: str, keys: Column) -> Column:
        return F.coalesce(F.transform(keys, lambda k: F.struct(F.lit(tag).alias("tag"), k.alias("key"))), empty)

    tagged = [of(tag, keys) for tag, keys in _keys(side)]
    kept = [F.col(c).alias(f"{side}_{c}") for c in ("id", "fold", "ids")]
    return records.select(*kept, F.explode(F.array_distinct(F.concat(*tagged))).alias("k")).select("*", "k.tag", "k.key").drop("k")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, rung, same_fold) of all rungs; pairs whose ids of one scheme differ are vetoed. One join on (tag, key) for all."""
    joined = _exploded(prepared(left), "l").join(_exploded(prepared(right), "r"), ["tag", "key"])
    same = F.col("l_fold") == F.col("r_fold")
    holds = F.when(F.col("tag") == "slip", one_slip(F.col("l_fold"), F.col("r_fold"))).when(F.col("tag") == "part", ~same).otherwise(True)
    clash = F.exists("l_ids", lambda x: F.exists("r_ids", lambda y: (F.substring_index(x, ":", 1) == F.substring_index(y, ":", 1)) & (x != y)))
    every = joined.where(holds & ((F.col("tag") == "id") | ~F.coalesce(clash, F.lit(False))))
    rung = F.create_map(*[F.lit(x) for item in _RUNG_OF.items() for x in item])[F.col("tag")]
    return every.groupBy(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")).agg(F.min(rung).alias("rung"), F.max(same).alias("same_fold"))


def settled(pairs: DataFrame, by: str = "left_id", to: str = "right_id") -> DataFrame:
    """(by, match, ambiguous, rung): the first rung that answers; of several answers the only one of equal fold, else none."""
    best = pairs.withColumn("first", F.min("rung").over(Window.partitionBy(by))).where("rung = first")
    grouped = best.groupBy(by).agg(F.first("rung").alias("rung"), F.sort_array(F.collect_set(to)).alias("all"), F.sort_array(F.collect_set(F.when(F.col("same_fold"), F.col(to)))).alias("same"))
    match = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size("same") == 1, F.get("same", F.lit(0)))
    return grouped.select(by, match.alias("match"), F.when(match.isNull(), F.col("all")).alias("ambiguous"), "rung")


def _classes(records: DataFrame, other: DataFrame) -> DataFrame:
    """(id, rep, n, forms): for each record the least id of those that say the same, how many they are, and their (title, year, ids).

    An id of a scheme that the other side does not know can neither match nor clash, so it sets no two records apart. Schemes are few, and
    only their names are gathered; an id without a scheme stands for itself.
    """
    scheme = lambda x: F.substring_index(x, ":", 1)
    known = other.select(F.explode("ids").alias("x")).where("instr(x, ':') > 0").select(scheme(F.col("x")).alias("s")).distinct()
    rows = records.crossJoin(F.broadcast(known.agg(F.collect_set("s").alias("__known"))))
    ids = F.filter("ids", lambda x: (F.instr(x, ":") == 0) | F.array_contains("__known", scheme(x)))
    form = F.struct("title", "year", F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))).alias("ids"))
    told = rows.groupBy("id").agg(F.sort_array(F.collect_set(form)).alias("forms"))
    reps = told.groupBy("forms").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return told.join(reps, "forms")


def mutual_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """``mutual`` of the candidates of records, of which those that say the same are linked once, by their least id.

    A pair is an answer for all records of its classes, so answers are counted by the classes' sizes; only classes that are matched are
    written out. Copies on both sides so cost what they are, not their product. Rows of one id are one record.
    """
    classes = {"left": _classes(left, right), "right": _classes(right, left)}

    def spoken(side: str) -> DataFrame:
        forms = classes[side].where("id = rep").select(F.col("rep").alias("id"), F.explode("forms").alias("f")).select("id", "f.*")
        return spread(forms, "id", "title")

    pairs = candidates(spoken("left"), spoken("right"))
    for side in ("left", "right"):
        size = classes[side].where("id = rep").select(F.col("rep").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"))
        pairs = pairs.join(size, f"{side}_id")

    def best(by: str, to: str) -> DataFrame:
        """The pairs of a record's first rung that answers, and what is the only answer, if any."""
        same = F.col("same_fold")
        counted = pairs.groupBy(f"{by}_id", "rung").agg(
            F.sum(f"{to}_n").alias("n"), F.min(f"{to}_id").alias("only"), F.sum(F.when(same, F.col(f"{to}_n"))).alias("n_same"), F.min(F.when(same, F.col(f"{to}_id"))).alias("only_same"),
        )
        first = counted.groupBy(f"{by}_id").agg(F.min_by(F.struct("*"), "rung").alias("b")).select("b.*")
        return first.select(f"{by}_id", "rung", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_same") == 1, F.col("only_same")).alias("match"))

    forth = best("left", "right").where("match is not null").select("left_id", F.col("match").alias("right_id"), "rung")
    back = pairs.select("left_id", "right_id", "rung").join(best("right", "left"), ["right_id", "rung"]).where("match is null or match = left_id")
    kept = forth.join(back, ["left_id", "right_id"], "left_semi").unionByName(forth.where(F.col("rung") == ID)).distinct()
    members = classes["left"].select(F.col("rep").alias("left_id"), "id")
    return kept.join(members, "left_id").select(F.col("id").alias("left_id"), "right_id", "rung")


def mutual(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, rung) of matches that hold on the way back too: there the answer is the record, or several that hold it.

    So each of several copies on one side is matched; a shared id needs no way back.
    """
    forth = settled(pairs).where("match is not null").select("left_id", F.col("match").alias("right_id"), "rung")
    back = settled(pairs, "right_id", "left_id")
    back = back.select("right_id", F.explode(F.when(F.col("match").isNotNull(), F.array("match")).otherwise(F.col("ambiguous"))).alias("left_id"))
    return forth.join(back, ["left_id", "right_id"], "left_semi").unionByName(forth.where(F.col("rung") == ID)).distinct()


def near_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of distinct keys one edit apart, both long enough: they share one of the keys with a character left out."""
    from cataloom.functions.titles import one_edit

    def blocked(side: DataFrame, name: str) -> DataFrame:
        keys = side.select(F.col(key).alias(name)).distinct()
        return keys.withColumn("block", F.explode(near_blocks(F.col(name))))

    pairs = blocked(left, "left_key").join(blocked(right, "right_key"), "block")
    return pairs.where(one_edit(F.col("left_key"), F.col("right_key"))).select("left_key", "right_key").distinct()
