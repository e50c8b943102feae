"""Text mining: token prevalence, first-seen plurality, counts, language of a text, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and endings that say nothing about a name, and stop words by language in tie order.
FRAGMENT_STOP_WORDS = (
    "the a an and or of to in on at by for with from into over under is are was were be been being am as it its this "
    "that these those he she they them his her their you your we our us i me my mine not no nor so if then than too very can "
    "will just but also s t d ll re ve m o mp3 mp4 mkv avi flac wav m4a mov webm opus jpg jpeg png gif txt pdf epub cbz "
    "cbr cb7 avif webp srt ass vtt"
).split()
LANGUAGE_WORDS = {
    "eng": "the and of to that is it was for with this but his are from have not you they what",
    "deu": "der die das und ist nicht sich ein eine auch aber wurde werden oder wenn doch schon noch nur mehr",
    "fra": "les des est une que qui dans pour pas plus avec mais cette elle tout être aussi comme leur sans",
    "spa": "los las que una por con para como pero más este esta sus sobre cuando muy todo hasta entre porque",
    "ita": "che non per con sono come alla dei delle questo anche quando essere tutto dopo senza molto perché sul nella",
    "nld": "het een van zijn niet dat maar ook worden deze naar door hij zij waren werd heeft over omdat nog",
    "por": "uma que não para com mais como mas sua seu quando muito até isso pelo pela também sobre então depois",
    "pol": "nie się jest że ale jak tak tym przez tylko jego może gdy oraz była było który która jeszcze bardzo",
    "ces": "že není jsem jsou byl byla jako ale když také tak jen který která ještě před protože může aby více",
    "hun": "hogy nem egy van meg már csak volt majd még ezt ami mint ilyen akkor minden lehet vagy azt ott",
    "tur": "bir için ile çok daha gibi olarak sonra kadar ancak ama değil olan şey zaman kendi oldu var yok onun",
}
LEAST_SCORE, SCRIPT_SHARE, BORDERLINE = 0.04, 0.15, 0.55
SCRIPTS = (("jpn", r"[\x{3042}-\x{30FF}]"), ("kor", r"[\x{AC00}-\x{D7A3}]"), ("zho", r"[\x{4E00}-\x{9FFF}]"), ("rus", r"[\x{0400}-\x{04FF}]"), ("ara", r"[\x{0600}-\x{06FF}]"), ("hin", r"[\x{0900}-\x{09FF}]"))


def tokens(text: Column, ascii_only: bool = False) -> Column:
    separators = "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    return F.filter(F.split(F.lower(text), separators), lambda t: t != "")


def prevalence(rows: DataFrame, name: str, least: int = 2, stop_words: Sequence[str] = FRAGMENT_STOP_WORDS, ascii_only: bool = False, ordered: bool = True) -> DataFrame:
    """(token, names): names a token occurs in, once each; a trailing extension, digits, single letters and stop words dropped.

    ``ordered`` puts the commonest first, which sorts the whole result.
    """
    bare = F.regexp_replace(F.lower(F.col(name)), r"\.[a-z][a-z0-9]{0,3}$", "")
    found = rows.select(F.explode(F.array_distinct(tokens(bare, ascii_only))).alias("token"))
    found = found.where((F.length("token") > 1) & ~F.col("token").rlike("^[0-9]+$") & ~F.col("token").isin(*stop_words))
    counted = found.groupBy("token").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") >= least)
    return counted.orderBy(F.desc("names"), "token") if ordered else counted


def plurality(rows: DataFrame, group: Sequence[str], key: str, position: str) -> DataFrame:
    """(group, key, n): the commonest key; of equally common ones the one seen first."""
    counted = rows.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
    return counted.groupBy(*group).agg(F.max_by(key, F.struct("n", -F.col("p"))).alias(key), F.max("n").alias("n"))


def text_counts(text: Column) -> tuple[Column, Column]:
    """Words between white space, and characters."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return words.cast("bigint"), F.char_length(text).cast("bigint")


def language(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, ambiguous) of each text: its script where that decides, else the language with most stop words.

    Words are joined with the fixed table of stop words, which is broadcast, and counted per key: one pass and one
    shuffle of a row per text. Rows of one key are one text.
    """
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    letters = F.regexp_count(body, F.lit(r"\p{L}"))
    script = F.when(F.lit(False), "")
    for code, pattern in SCRIPTS:
        script = script.when(F.regexp_count(body, F.lit(pattern)) >= letters * SCRIPT_SHARE, code)
    foreign = body.rlike("[" + "".join(pattern[1:-1] for _, pattern in SCRIPTS) + "]")  # spares most texts the counts
    words = F.filter(F.split(body, r"[^\p{L}]+"), lambda w: w != "")
    ready = rows.select(F.col(key).alias("key"), words.alias("words"), F.when(foreign, script).alias("script"))
    spread = ready.select("key", "script", F.size("words").alias("n"), F.posexplode_outer("words").alias("at", "word"))
    hits = spread.join(F.broadcast(_table(rows)), "word", "left")  # some two hundred words
    first = F.col("at").isNull() | (F.col("at") == 0)
    sums = [F.sum(F.shiftright("languages", i).bitwiseAND(1)).alias(code) for i, code in enumerate(LANGUAGE_WORDS)]
    counted = hits.groupBy("key").agg(F.max("script").alias("script"), F.sum(F.when(first, F.col("n"))).alias("n"), *sums)
    ranked = F.array_sort(F.array(*[F.struct((-F.coalesce(code, F.lit(0)) / F.nullif("n", F.lit(0))).alias("neg"), F.lit(i).alias("order"), F.lit(code).alias("code")) for i, code in enumerate(LANGUAGE_WORDS)]))
    counted = counted.withColumn("ranked", ranked)
    best, second = -F.col("ranked")[0]["neg"], -F.col("ranked")[1]["neg"]
    code = F.when(F.col("script").isNotNull(), F.col("script")).when(best >= LEAST_SCORE, F.col("ranked")[0]["code"]).otherwise("")
    ambiguous = F.col("script").isNull() & (best >= LEAST_SCORE) & (second >= LEAST_SCORE) & (second >= best * BORDERLINE)
    return counted.select(F.col("key").alias(key), code.alias("code"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def _table(rows: DataFrame) -> DataFrame:
    """(word, languages): a bit for each language that has the word as a stop word."""
    bits: dict[str, int] = {}
    for i, table in enumerate(LANGUAGE_WORDS.values()):
        for word in table.split():
            bits[word] = bits.get(word, 0) | 1 << i
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(b).alias("languages")) for w, b in bits.items()])
    return rows.sparkSession.range(1).select(F.inline(pairs))


def new_word_share(words: Column, known: Column) -> Column:
    """Share of distinct words that the other text lacks."""
    mine = F.array_distinct(words)
    return F.size(F.array_except(mine, known)) / F.nullif(F.size(mine), F.lit(0))


def share(rows: DataFrame, group: Sequence[str], hit: Column) -> DataFrame:
    return rows.groupBy(*group).agg((F.count_if(hit) / F.count(F.lit(1))).alias("share"))


def group_flags(rows: DataFrame, group: Sequence[str], value: str, number: str) -> DataFrame:
    """Adds whether all members of a group share a value, and whether their numbers run without a gap."""
    w = Window.partitionBy(*group)
    same = F.min(value).over(w) == F.max(value).over(w)
    gapless = F.max(number).over(w) - F.min(number).over(w) + 1 == F.size(F.collect_set(number).over(w))
    return rows.withColumns({"shared": same, "gapless": gapless})
