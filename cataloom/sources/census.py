"""Census reports and other typed text files: strict schemas, no inference, names of files as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of each report, in order.
SCHEMAS = {
    "audio": "path string, sizeBytes bigint, durationSeconds double, bitrateBitsPerSecond bigint, bitrateAdequacy string, channels int, codec string, chapters int",
    "video": "path string, sizeBytes bigint, durationSeconds double, videoBitrateBitsPerSecond bigint, bitrateAdequacy string, resolution string, frameRateFps double, videoCodec string, container string, dynamicRange string, audioTracks int, firstAudioChannels int, firstAudioCodec string, firstAudioBitrateBitsPerSecond bigint, subtitleTracks int, chapters int",
    "images": "path string, sizeBytes bigint, sizeAdequacy string, resolution string, imageCodec string",
    "books": "path string, sizeBytes bigint, pages int, words bigint, characters bigint",
    "comics": "path string, sizeBytes bigint, pages int, firstPageResolution string, container string, imageCodec string",
}
TITLE_COLUMNS = {
    "basics": "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, startYear string, endYear string, runtimeMinutes string, genres string",
    "akas": "titleId string, ordering string, title string, region string, language string, types string, attributes string, isOriginalTitle string",
}
TITLE_KINDS = ("movie", "tvMovie", "tvSpecial", "video", "short")


class ReportError(ValueError):
    """A named report that is not what its name says."""


@dataclass
class Found:
    """Reports by content type, and those skipped with the reason."""

    reports: dict[str, list[str]]
    skipped: list[tuple[str, str]]


def schema_of(content: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[content])


def separator(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def classify(spark: SparkSession, paths: Sequence[str], named: bool = True) -> Found:
    """Binds reports to types by file name and exact header; a named misfit is refused, a found one skipped.

    Headers are compared as text, since Spark's own check does not mind case. One job reads all first lines.
    """
    found = Found({}, [])
    if not paths:
        return found
    lines = spark.read.option("wholetext", False).text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").groupBy("path").agg(F.first("value").alias("header")).collect()  # a line a file
    headers = {r["path"].rsplit("/", 1)[-1]: r["header"].removesuffix("\r") for r in first}
    for path in sorted(paths):
        name = path.rsplit("/", 1)[-1]
        content = next((c for c in SCHEMAS if name.lower().startswith(c)), None)
        if content and headers.get(name, "") == separator(path).join(schema_of(content).names):
            found.reports.setdefault(content, []).append(path)
            continue
        reason = "not a report's name" if content is None else "another header"
        if named:
            raise ReportError(f"{path}: {reason}")
        found.skipped.append((path, reason))
    for content, files in found.reports.items():
        if len({separator(f) for f in files}) > 1:
            raise ReportError(f"{content}: comma and tab separated reports together")
    return found


def scan(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder that have one of the extensions, in any case; contents are not read."""
    from cataloom.functions.files import lower_extension_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.where(lower_extension_of(F.col("path")).isin(*[e.lower() for e in extensions]))


def folders_at(paths: DataFrame, path: str, root: str, depth: int) -> DataFrame:
    """(folder) distinct folders that lie exactly ``depth`` levels below ``root`` on the way to some path."""
    below = F.substring(F.col(path), len(root.rstrip("/")) + 2, 1 << 20)
    parts = F.split(below, "/")
    inside = paths.where(F.col(path).startswith(root.rstrip("/") + "/") & (F.size(parts) > depth))
    return inside.select(F.concat_ws("/", F.lit(root.rstrip("/")), F.array_join(F.slice(parts, 1, depth), "/")).alias("folder")).distinct()


def is_stale(spark: SparkSession, index: str, inputs: Sequence[str], most_days: int | None = None) -> bool:
    """Whether a written table is missing, older than one of its inputs, or older than so many days."""
    def newest(paths: Sequence[str]):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).agg(F.max("modificationTime").alias("m"), F.current_timestamp().alias("now")).collect()[0]

    try:
        built = newest([index])
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return True
        raise
    old = most_days is not None and built["m"] is not None and (built["now"] - built["m"]).days >= most_days
    return built["m"] is None or built["m"] < newest(inputs)["m"] or old


def replace_table(rows: DataFrame, name: str) -> None:
    """A table in the warehouse, replaced whole; ``rows.createOrReplaceTempView`` is the view of the same kind."""
    rows.write.mode("overwrite").saveAsTable(name)


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """(place, cells) of a provider table in its order: tab-separated cells, comments and empty lines left out. The first match wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
    return lines.where("line not like '#%' and trim(line) <> ''").select("place", F.split("line", "\t", -1).alias("cells"))


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Report files below a folder in any store Spark reads, in byte order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,tsv}").load(folder)
    return sorted(r["path"] for r in files.select("path").collect())


def read_report(spark: SparkSession, paths: Sequence[str], content: str) -> DataFrame:
    """Rows of reports of one type with the column ``filename``; an empty cell is null, a bad number fails the read."""
    sep = separator(paths[0])
    reader = spark.read.schema(SCHEMAS[content]).option("header", True).option("sep", sep).option("nullValue", "").option("enforceSchema", False).option("mode", "FAILFAST")
    if sep == ",":
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True)
    else:
        reader = reader.option("quote", "")
    rows = reader.csv(list(paths))
    return rows.select("*", F.col("_metadata.file_name").alias("filename"))


def read_titles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A gzipped title list as text; one file is one task, so rows are dealt anew."""
    rows = spark.read.schema(TITLE_COLUMNS[kind]).option("header", True).option("sep", "\t").option("quote", "").option("nullValue", r"\N").csv(path)
    return rows.repartition(spark.sparkContext.defaultParallelism)


def write_csv(rows: DataFrame, path: str, order: Sequence[str] = (), one_file: bool = False) -> None:
    """CSV with a header; ``order`` sorts it over all its files, ``one_file`` writes it through one task."""
    ordered = rows.orderBy(*order) if order else rows
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Unquoted; tabs and line ends in text become spaces, and ``sanitised`` says where."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    dirty = F.lit(False)
    for t in texts:
        dirty = dirty | F.coalesce(F.col(t).rlike("[\t\n\r]"), F.lit(False))
    clean = {t: F.translate(t, "\t\n\r", "   ") for t in texts}
    rows.withColumn("sanitised", dirty).withColumns(clean).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a torn line is skipped whole."""
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, __torn string", {"columnNameOfCorruptRecord": "__torn"}).alias("r")).where("r is not null and r.__torn is null")
    return parsed.select("r.*").drop("__torn")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(name) of each entry of a drawn tree."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^[\s│├└─|`+\-]*", "")).alias("name")).where("name <> ''")


# Columns of a feed table, its profiles and the one that holds where none is named, and options that a row may not carry.
FEED_COLUMNS = ("active", "subdir", "nameTemplate", "playlistEnd", "extraArgs", "url")
FEED_PROFILES = ("youtubeAudio", "youtubeVideo", "rssAudio", "rssVideo", "siteVideo")
REFUSED_OPTIONS = ("-o", "--output", "-P", "--paths", "--exec", "--exec-before-download", "--config-location")


def read_feed_table(spark: SparkSession, path: str | list[str], convertible: Sequence[str] = FEED_PROFILES[:1]) -> DataFrame:
    """Rows of feed tables: file, line, the six columns, profile, jobs, ingest, faults (all of a line's at once) and sound, whether the file has none.

    ``#!`` lines give a file's settings in its order: of several that name one setting the last one that is right holds, for all rows of the
    file. A file with a setting ``ingest`` needs a profile among ``convertible``. Faulty ``#!`` lines are rows without columns. Each file is
    read whole, as the order of its lines counts; blank lines and other comments are left out.
    """
    from pyspark.sql import Window

    blank = "[ \t\r\x0B\f]"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    lines = text.select("file", (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text")).where(~F.col("text").rlike(f"^{blank}*$"))
    said = F.startswith("text", F.lit("#!"))
    lines = lines.where(said | ~F.startswith("text", F.lit("#")))
    setting = f"^#!{blank}*([A-Za-z]+){blank}+([^ \t\r\x0B\f]+){blank}*$"
    ingest = f"^#!{blank}*ingest{blank}+(.*)$"
    name = F.when(F.col("text").rlike(ingest), "ingest").otherwise(F.regexp_extract("text", setting, 1))
    value = F.when(name == "ingest", F.trim(F.regexp_extract("text", ingest, 1))).otherwise(F.regexp_extract("text", setting, 2))
    lines = lines.select("*", said.alias("said"), F.when(said, name).alias("name"), F.when(said, value).alias("value"))
    right = F.when(F.col("name") == "ingest", F.col("value") != "").when(F.col("name") == "profile", F.col("value").isin(*FEED_PROFILES)).when(F.col("name") == "jobs", F.col("value").rlike("^[1-9][0-9]*$"))
    lines = lines.withColumn("right", F.coalesce(right, F.lit(False)))
    cells = F.split("text", "\t", -1)
    for i, column in enumerate(FEED_COLUMNS):
        lines = lines.withColumn(column, F.when(~F.col("said") & (F.size(cells) == len(FEED_COLUMNS)), F.get(cells, F.lit(i))))
    whole = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda n, what: F.last(F.when((F.col("name") == n) & F.col("right"), what), ignorenulls=True).over(whole)
    lines = lines.withColumns({"profile": F.coalesce(last("profile", F.col("value")), F.lit(FEED_PROFILES[0])), "ingest": last("ingest", F.col("value")), "asked": last("ingest", F.col("line")), "jobs": last("jobs", F.col("value"))})
    lines = lines.withColumn("jobs", F.coalesce("jobs", F.when(F.startswith("profile", F.lit("rss")), "10").otherwise("1")).cast("int"))
    leaves = lambda c: F.startswith(c, F.lit("/")) | F.contains(c, F.lit(".."))
    options = F.filter(F.split("extraArgs", r"\s+"), lambda w: F.substring_index(w, "=", 1).isin(*REFUSED_OPTIONS))
    row, whole_row = ~F.col("said"), F.col("active").isNotNull()
    rules = [
        (F.col("said") & ~F.col("right"), F.when(F.col("name") == "", "no setting").otherwise("unknown setting, or a wrong value of one")),
        (F.col("said") & (F.col("line") == F.col("asked")) & ~F.col("profile").isin(*convertible), F.lit("ingest needs a profile that is converted")),
        (row & ~whole_row, F.lit("wrong number of columns")),
        (whole_row & ~F.col("active").isin("0", "1"), F.lit("active is 0 or 1")),
        (whole_row & (F.col("subdir") == ""), F.lit("subdir is empty")),
        (whole_row & leaves("subdir"), F.lit("subdir leaves the folder")),
        (whole_row & leaves("nameTemplate"), F.lit("nameTemplate leaves the folder")),
        (whole_row & (F.size(options) > 0), F.lit("extraArgs carries a refused option")),
        (whole_row & ~F.col("playlistEnd").rlike("^[0-9]*$"), F.lit("playlistEnd is a number")),
        (whole_row & ~F.col("url").rlike("^https?://"), F.lit("url is not one")),
    ]
    faults = F.filter(F.array(*[F.when(bad, told) for bad, told in rules]), lambda x: x.isNotNull())
    lines = lines.withColumn("faults", faults).withColumn("sound", F.max(F.size("faults")).over(Window.partitionBy("file")) == 0)
    return lines.where(~F.col("said") | (F.size("faults") > 0)).select("file", "line", *FEED_COLUMNS, "profile", "jobs", "ingest", "faults", "sound")


def read_cues(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start_ms, end_ms, lines) of SRT or WebVTT cue blocks."""
    blocks = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("n", "block"))
    stamp = r"((?:[0-9]+:)?[0-9]{2}:[0-9]{2}[.,][0-9]{3})"
    pattern = stamp + r"[ \t]*-->[ \t]*" + stamp
    timed = blocks.where(F.col("block").rlike(pattern))

    def ms(i: int):
        parts = F.reverse(F.split(F.translate(F.regexp_extract("block", pattern, i), ",", "."), ":"))
        whole = F.get(parts, F.lit(0)).cast("double") + F.get(parts, F.lit(1)).cast("int") * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0)) * 3600
        return F.round(whole * 1000).cast("bigint")

    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    return timed.select(key, "n", ms(1).alias("start_ms"), ms(2).alias("end_ms"), lines.alias("lines"))


def read_cue_sheets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, track, title, performer, start_ms) of cue sheets: each line belongs to the last TRACK before it; lines before the first are the disc's."""
    from pyspark.sql import Window

    lines = rows.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    track = F.regexp_extract("line", r"^(?i:TRACK)\s+([0-9]+)\s", 1).try_cast("int")
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("track", F.last(track, ignorenulls=True).over(order)).where("track is not null")
    said = lambda word: F.max(F.nullif(F.regexp_extract("line", rf'^(?i:{word})\s+"?(.*?)"?$', 1), F.lit("")))
    stamp = F.nullif(F.regexp_extract("line", r"^(?i:INDEX)\s+01\s+([0-9:]+)", 1), F.lit(""))
    return placed.groupBy(key, "track").agg(said("TITLE").alias("title"), said("PERFORMER").alias("performer"), F.max(cue_frames_ms(stamp)).alias("start_ms"))


def cue_frames_ms(stamp: Column) -> Column:
    """MM:SS:FF of a cue sheet in milliseconds; a frame is 1/75 second, rounded half up."""
    m, s, f = (F.regexp_extract(stamp, r"^([0-9]+):([0-9]{2}):([0-9]{2})$", i).try_cast("bigint") for i in (1, 2, 3))
    return m * 60000 + s * 1000 + F.floor((f * 1000 + 37) / 75)
