"""The library's operators as queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import adequacy, dimensions, files, formats, titles, tracks
from cataloom.operators import cubes, curves, gaps, intervals, linkage, mining, sync, tallies
from cataloom.plans import catalogue  # noqa: F401 - registers its queries
from cataloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from cataloom.sources import census, probe
from cataloom.session import table

# --- cubes ---------------------------------------------------------------------------------------------------------

_BAND = "CASE WHEN l_quantity IS NULL THEN 'unknown' WHEN l_quantity < 10 THEN '<010' WHEN l_quantity < 25 THEN '<025' WHEN l_quantity < 40 THEN '<040' ELSE '>040' END"
_AXES = ["l_returnflag", "l_linestatus", "band"]
# a product is null where one of its factors is, and so is a sum: neither side needs a condition
_MEAN = "CAST(ROUND(1000 * SUM(l_quantity * l_discount) / NULLIF(SUM(l_quantity + 0 * l_discount), 0)) AS BIGINT)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    band = F.when(q.isNull(), "unknown").when(q < 10, "<010").when(q < 25, "<025").when(q < 40, "<040").otherwise(">040")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", band.alias("band"), cents.alias("cents"), (F.col("l_discount") * 1000).alias("permille"), q)


def _lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.cube(_facts(spark, sf_dir), _AXES, ["cents"], {"mean_permille": ("permille", "l_quantity")})


_CUBE_SQL = f"""
SELECT COALESCE(l_returnflag, 'ALL') AS l_returnflag, COALESCE(l_linestatus, 'ALL') AS l_linestatus, COALESCE(band, 'ALL') AS band,
  CAST((l_returnflag IS NOT NULL)::INT + (l_linestatus IS NOT NULL)::INT + (band IS NOT NULL)::INT AS INTEGER) AS depth,
  COUNT(*) AS files, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, {_MEAN} AS mean_permille
FROM (SELECT *, {_BAND} AS band FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, band)"""


@query(_CUBE_SQL)
def cube_lineitem(spark, sf_dir):
    return _lineitem_cube(spark, sf_dir)


@query(f"SELECT * FROM ({_CUBE_SQL}) WHERE depth = 0")
def cube_totals(spark, sf_dir):
    return cubes.total_row(_lineitem_cube(spark, sf_dir))


@query(f"SELECT * FROM ({_CUBE_SQL}) WHERE depth = 1")
def cube_depth1(spark, sf_dir):
    return _lineitem_cube(spark, sf_dir).where("depth = 1")


_WIDE = ["l_returnflag", "l_linestatus", "line", "month", "disc", "tax", "band"]


@query(f"""
WITH f AS (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS line, CAST(month(l_shipdate) AS VARCHAR) AS month,
  CAST(CAST(FLOOR(l_discount * 20) AS BIGINT) AS VARCHAR) AS disc, CAST(CAST(FLOOR(l_tax * 20) AS BIGINT) AS VARCHAR) AS tax, {_BAND} AS band FROM lineitem)
SELECT {", ".join(f"COALESCE({a}, 'ALL') AS {a}" for a in _WIDE)}, CAST({" + ".join(f"({a} IS NOT NULL)::INT" for a in _WIDE)} AS INTEGER) AS depth, COUNT(*) AS files
FROM f GROUP BY CUBE ({", ".join(_WIDE)})""")
def cube_wide(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    band = F.expr(_BAND)
    step = lambda c: F.floor(F.col(c) * 20).cast("string")
    facts = rows.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"), F.month("l_shipdate").cast("string").alias("month"), step("l_discount").alias("disc"), step("l_tax").alias("tax"), band.alias("band"))
    return cubes.cube(facts, _WIDE)


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS files, ROUND(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e5, 4) AS kilo FROM orders GROUP BY ALL")
def grain_orders(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    grain = cubes.base_grain(facts, ["o_orderstatus", "o_orderpriority"], ["cents"])
    return grain.select("o_orderstatus", "o_orderpriority", "files", F.round(F.col("cents").cast("double") / 1e5, 4).alias("kilo"))


@query(f"SELECT l_returnflag, {_MEAN} AS mean_permille FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    grain = cubes.base_grain(_facts(spark, sf_dir), ["l_returnflag"], weighted={"mean_permille": ("permille", "l_quantity")})
    return grain.select("l_returnflag", cubes.mean_of("mean_permille").alias("mean_permille"))


@query("SELECT (SELECT COUNT(*) FROM orders) || '|' || (SELECT COUNT(*) FROM customer) || '|' || (SELECT COUNT(*) FROM part) AS counts")
def scalar_counts(spark, sf_dir):
    for name in ("orders", "customer", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"cataloom_{name}")
    return spark.sql("SELECT concat_ws('|', (SELECT count(*) FROM cataloom_orders), (SELECT count(*) FROM cataloom_customer), (SELECT count(*) FROM cataloom_part)) AS counts")


# --- dimensions ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, COALESCE(NULLIF(lower(trim(p_brand)), ''), 'unknown') AS brand, COALESCE(CAST(p_size AS VARCHAR), 'unknown') AS size FROM part")
def text_and_number_dimension(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", dimensions.text_dimension(F.col("p_brand")).alias("brand"), dimensions.number_dimension(F.col("p_size")).alias("size"))


@query(r"SELECT page_id, COALESCE(NULLIF(lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)), ''), 'unknown') AS suffix, COALESCE(NULLIF(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '^http', ''), ''), 'unknown') AS library FROM pages")
def suffix_and_library_dimension(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", dimensions.suffix_dimension(url).alias("suffix"), dimensions.library_dimension(url, "http").alias("library"))


_TIERS = " ".join(f"WHEN COALESCE(w, 0) >= {w} OR COALESCE(h, 0) >= {h} THEN '{n}'" for n, w, h in reversed(dimensions.RESOLUTIONS))
_ASPECTS = " ".join(f"WHEN w / h < {b} THEN '{n}'" for n, b in dimensions.aspect_bounds())
_SIZES = "SELECT p_partkey, CAST(p_size * 97 AS BIGINT) AS w, CAST(p_retailprice AS BIGINT) AS h FROM part"


@query(f"SELECT p_partkey, CASE WHEN w IS NULL AND h IS NULL THEN 'unknown' {_TIERS} ELSE 'SD' END AS tier, CASE WHEN w <= 0 OR h <= 0 THEN 'unknown' {_ASPECTS} ELSE '4.00:1' END AS aspect FROM ({_SIZES.replace('CAST(p_retailprice AS BIGINT)', 'CAST(FLOOR(p_retailprice) AS BIGINT)')})")
def resolution_and_aspect(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("bigint").alias("w"), F.floor("p_retailprice").alias("h"))
    w, h = F.col("w"), F.col("h")
    return rows.select("p_partkey", dimensions.resolution_tier(w, h).alias("tier"), dimensions.aspect_bucket(w, h).alias("aspect"))


_BANDS = " ".join(f"WHEN rate < {limit} THEN '{label}'" for limit, label in dimensions.BITRATE_BANDS["audio"][:-1])


@query(f"SELECT o_orderkey, CASE WHEN rate IS NULL THEN 'unknown' {_BANDS} ELSE '>750kbps' END AS tier, CASE WHEN rate IS NULL THEN 'unknown' WHEN rate > 30 THEN 'yes' ELSE 'no' END AS hfr FROM (SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS rate FROM orders)")
def bitrate_tier_and_hfr(spark, sf_dir):
    rate = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", dimensions.bitrate_tier(rate, "audio").alias("tier"), dimensions.high_frame_rate(rate).alias("hfr"))


_CODECS = ["H265 ", "x264", "mpeg2video", "AV1", "theora", "", "wmv3", "odd", "VVC", "prores"]
_CODEC_VALUE = "CASE CAST(p_partkey % 10 AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODECS)) + " END"


def _codec_sql(pick: int) -> str:
    arms = " ".join(f"WHEN lower(trim(c)) IN ({', '.join(repr(x) for x in dict.fromkeys([r[0], *r[2]]))}) THEN '{r[pick]}'" for r in dimensions.VIDEO_CODECS)
    return f"CASE WHEN c IS NULL OR trim(c) = '' THEN 'unknown' {arms} ELSE 'unknown' END"


@query(f"SELECT p_partkey, {_codec_sql(0)} AS family, {_codec_sql(1)} AS era FROM (SELECT p_partkey, {_CODEC_VALUE} AS c FROM part)")
def codec_family_and_era(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODEC_VALUE).alias("c"))
    return rows.select("p_partkey", dimensions.codec_family(F.col("c")).alias("family"), dimensions.codec_era(F.col("c")).alias("era"))


_RANGES = ["SDR", "HDR10", "DolbyVision P5", "HLG", "smpte2084 PQ", "", "hdr10+", "dolby vision 8", "bt709"]
_RANGE_VALUE = "CASE CAST(p_partkey % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_RANGES)) + " END"


@query(f"SELECT p_partkey, COALESCE(list_filter([CASE WHEN regexp_matches(u, 'DOLBY ?VISION') THEN 'DV' END, CASE WHEN u = 'SDR' THEN 'SDR' END, CASE WHEN regexp_matches(u, '(HDR|HLG|PQ)') THEN 'HDR' END], lambda x: x IS NOT NULL)[1], 'unknown') AS range FROM (SELECT p_partkey, upper({_RANGE_VALUE}) AS u FROM part)")
def dynamic_range_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_RANGE_VALUE).alias("r"))
    return rows.select("p_partkey", dimensions.dynamic_range(F.col("r")).alias("range"))


@query(r"SELECT p_partkey, TRY_CAST(regexp_extract(t, '^\s*([0-9]+)[xX]([0-9]+)\s*$', 1) AS BIGINT) AS width, TRY_CAST(regexp_extract(t, '^\s*([0-9]+)[xX]([0-9]+)\s*$', 2) AS BIGINT) AS height, TRY_CAST(regexp_extract(t, '^\s*([0-9]+)[xX]([0-9]+)\s*$', 1) AS BIGINT) * TRY_CAST(regexp_extract(t, '^\s*([0-9]+)[xX]([0-9]+)\s*$', 2) AS BIGINT) AS pixels FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_size || 'x' || p_partkey END AS t FROM part)")
def size_parse(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("x"), F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    w, h = dimensions.parsed_size(F.col("t"))
    return rows.select("p_partkey", w.alias("width"), h.alias("height"), (w * h).alias("pixels"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE NULLIF(FLOOR((p_partkey * 1000 + FLOOR((p_size % 3) * 1001 / 2)) / ((p_size % 3) * 1001)) / 1000, 0) END AS rate, CASE WHEN p_brand ~ '^[0-9]+$' THEN CAST(p_brand AS BIGINT) END AS whole FROM part")
def coercions(spark, sf_dir):
    rate = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), ((F.col("p_size") % 3) * 1001).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", dimensions.to_frame_rate(rate).alias("rate"), dimensions.to_whole(F.col("p_brand")).alias("whole"))


# --- adequacy ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN have <= 0 OR need <= 0 THEN 'unknown' WHEN have < need THEN 'starved' WHEN have >= need * 2 THEN 'generous' ELSE 'adequate' END AS verdict FROM (SELECT l_orderkey, l_linenumber, CAST(ROUND(l_extendedprice) AS BIGINT) AS have, CAST(l_quantity * 1000 AS BIGINT) AS need FROM lineitem)")
def adequacy_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    have, need = F.round("l_extendedprice").cast("bigint"), (F.col("l_quantity") * 1000).cast("bigint")
    return rows.select("l_orderkey", "l_linenumber", adequacy.verdict(have, need).alias("verdict"))


_VIDEO_FACTOR = "CASE f " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in adequacy.VIDEO_TUNING.items()) + " ELSE 1.0 END"
_VIDEO_POWER = "CASE f " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in adequacy.VIDEO_TUNING.items()) + " ELSE 0.8 END"
_VIDEO_ERA = "CASE e " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in adequacy.ERA_PENALTY.items()) + " ELSE 1.0 END"


@query(f"""
WITH c AS (SELECT p_partkey, p_size, {_CODEC_VALUE} AS c FROM part),
 b AS (SELECT p_partkey, p_size, {_codec_sql(0)} AS f, {_codec_sql(1)} AS e, LEAST(GREATEST((CAST(p_size AS DOUBLE) - 20) / 20, 0.0), 1.0) AS g FROM c)
SELECT p_partkey, CAST(ROUND(5000 * ({_VIDEO_FACTOR} + (1 - {_VIDEO_FACTOR}) * g) * POW(3686400.0 / 2073600, {_VIDEO_POWER} + (1 - {_VIDEO_POWER}) * g) * (2000.0 * 1000 / 3686400) * (1 + 0.5 * g)
  * (CASE WHEN p_size > 30 THEN LEAST(POW(CAST(p_size AS DOUBLE) / 30, 0.585), 2.0) ELSE 1.0 END) * {_VIDEO_ERA}) AS BIGINT) AS kbit FROM b""")
def video_requirement(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.expr(_CODEC_VALUE).alias("c"))
    need = adequacy.video_requirement(F.col("c"), F.lit(2000.0), F.lit(1000.0), F.lit(3686400.0), F.col("s"), F.col("s"))
    return rows.select("p_partkey", need.cast("bigint").alias("kbit"))


_AUDIO = [(name, row[0], row[1], row[2]) for row in adequacy.AUDIO_CODECS for name in dict.fromkeys((row[0], *row[3]))] + [("odd", "unknown", False, 1.0)]
_AUDIO_ROWS = ", ".join(f"({i}, '{n}', '{f}', {l}, {c})" for i, (n, f, l, c) in enumerate(_AUDIO))
_ANCHORS = {kind: ", ".join(map(str, row)) for kind, row in adequacy.AUDIO_ANCHOR.items()}


@query(f"""
WITH c(i, name, family, lossless, cost) AS (VALUES {_AUDIO_ROWS}),
 p AS (SELECT p_partkey, CAST(p_partkey % 10 AS INTEGER) AS ch, p_partkey % {len(_AUDIO)} AS i, CASE WHEN p_size % 2 = 0 THEN [{_ANCHORS['music']}] ELSE [{_ANCHORS['speech']}] END AS anchor FROM part),
 r AS (SELECT *, CASE WHEN ch BETWEEN 1 AND 8 THEN CAST(round_even(list_extract(anchor, ch) * CAST(cost AS DOUBLE), 0) AS BIGINT) END AS kbit FROM p JOIN c USING (i))
SELECT p_partkey, family, kbit, CASE WHEN kbit IS NULL OR p_partkey <= 0 THEN 'unknown' WHEN p_partkey >= 2 * kbit THEN 'generous' WHEN p_partkey >= kbit OR lossless THEN 'adequate' ELSE 'starved' END AS verdict FROM r""")
def audio_requirement(spark, sf_dir):
    """Every name of every audio codec, for music and for speech."""
    key = F.col("p_partkey")
    codec = F.get(F.array(*[F.lit(n.upper()) for n, *_ in _AUDIO]), (key % len(_AUDIO)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", codec.alias("codec"), (key % 10).cast("int").alias("ch"), F.when(F.col("p_size") % 2 == 0, "music").otherwise("speech").alias("content"))
    need = adequacy.audio_requirement(F.col("codec"), F.col("ch"), F.col("content"))
    return rows.select("p_partkey", adequacy.audio_family(F.col("codec")).alias("family"), need.cast("bigint").alias("kbit"), adequacy.audio_adequacy(F.col("codec"), F.col("ch"), key * 1000, F.col("content")).alias("verdict"))


_IMAGES = [(name, row[0], row[1]) for row in dimensions.IMAGE_FORMATS for name in dict.fromkeys((row[0], *row[2].split()))] + [("odd", "unknown", "unknown"), ("", "unknown", "unknown")]


@query("WITH f(i, name, family, kind) AS (VALUES " + ", ".join(f"({i}, '{n}', '{f}', '{k}')" for i, (n, f, k) in enumerate(_IMAGES)) + f") SELECT p_partkey, family, kind FROM part JOIN f ON p_partkey % {len(_IMAGES)} = i")
def image_family_and_kind(spark, sf_dir):
    """Every extension and alias of every picture format, with and without a dot, in either case."""
    key = F.col("p_partkey")
    name = F.get(F.array(*[F.lit(n) for n, *_ in _IMAGES]), (key % len(_IMAGES)).cast("int"))
    name = F.when(key % 2 == 0, F.concat(F.lit("."), F.upper(name))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", dimensions.image_family(name).alias("family"), dimensions.image_kind(name).alias("kind"))


_KIND_OF = files._by_extension(files.FILE_KINDS)
_REPORT_OF = files._by_extension(files.REPORTS)
_EXTENSIONS = [*dict.fromkeys([*_KIND_OF, *_REPORT_OF, "xyz"])]


@query("WITH e(i, ext, kind, report) AS (VALUES " + ", ".join(f"({i}, '{e}', '{_KIND_OF.get(e.rsplit('.', 1)[-1], e.rsplit('.', 1)[-1])}', '{_REPORT_OF.get(e.rsplit('.', 1)[-1], '')}')" for i, e in enumerate(_EXTENSIONS)) + f""")
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '' ELSE kind END AS kind, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN CASE WHEN ext = 'pdf' THEN 'comics' ELSE report END ELSE report END AS report FROM part JOIN e ON p_partkey % {len(_EXTENSIONS)} = i""")
def file_kinds(spark, sf_dir):
    """Kind and report by extension; names that begin with a dot or have none have no kind; a comic PDF is a comic."""
    key, size = F.col("p_partkey"), F.col("p_size") % 5
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (key % len(_EXTENSIONS)).cast("int"))
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.when(size == 0, F.concat(F.lit("a.b/."), base, F.lit("."), ext)).when(size == 1, F.concat(F.lit("a.b/"), base)).otherwise(F.concat(F.lit("a/"), base, F.lit("."), F.upper(ext)))
    return table(spark, sf_dir, "part").select("p_partkey", files.file_kind(path).alias("kind"), files.report_of(path, size == 2).alias("report"))


_DEMUXERS = ["matroska,webm", "mov,mp4,m4a,3gp,3g2,mj2", "avi", "mpegts", "", "ogg"]
_SUFFIXES = ["mkv", "webm", "mp4", "MJ2", "avi", "", "ts"]
_TRANSFERS = ["smpte2084", "arib-std-b67", "bt709", "", "PQ", "HLG"]


def _cycled(values: list[str], key: str = "p_partkey") -> str:
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"""
WITH t AS (SELECT p_partkey, {_cycled(_DEMUXERS)} AS d, lower({_cycled(_SUFFIXES)}) AS x, lower({_cycled(_TRANSFERS, 'p_size')}) AS t, p_partkey % 4 = 0 AS dv, p_partkey % 3 = 0 AS plus FROM part),
 u AS (SELECT *, string_split(d, ',') AS f, regexp_matches(t, 'b67|hlg') AS hlg, regexp_matches(t, 'b67|hlg|2084|pq') AS hdr FROM t)
SELECT p_partkey, CASE WHEN d = '' OR list_contains(f, x) AND x <> '' THEN x WHEN list_contains(f, 'matroska') THEN 'matroska' WHEN f[1] = 'mov' THEN 'mp4' ELSE f[1] END AS container,
 CASE WHEN dv THEN 'DolbyVision' || CASE WHEN hlg THEN '+HLG' WHEN hdr THEN '+HDR10' ELSE '' END WHEN plus THEN 'HDR10+' WHEN hlg THEN 'HLG' WHEN hdr THEN 'HDR10' ELSE 'SDR' END AS range FROM u""")
def container_and_range(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in (("d", _cycled(_DEMUXERS)), ("x", _cycled(_SUFFIXES)), ("t", _cycled(_TRANSFERS, "p_size")))])
    key = F.col("p_partkey")
    return rows.select("p_partkey", files.container_name(F.col("d"), F.col("x")).alias("container"), files.range_name(F.col("t"), key % 4 == 0, key % 3 == 0).alias("range"))


@query("""
WITH t AS (SELECT o_orderkey, CAST(o_orderkey * 37 % 20000 AS BIGINT) AS s, o_orderkey % 40 / 4 + o_orderkey % 7 AS q, CAST(o_orderkey AS BIGINT) * 7919 % 3000000007 AS b FROM orders)
SELECT o_orderkey, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS hms, CASE WHEN s < 3600 THEN printf('%d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) END AS clock,
 CASE WHEN q < 10 THEN printf('%.2f', q) ELSE printf('%.1f', q) END AS ratio,
 CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN printf('%.1f kB', b / 1000) WHEN b < 1000000000 THEN printf('%.1f MB', b / 1000000) ELSE printf('%.2f GB', b / 1000000000) END AS size FROM t""")
def human_formats(spark, sf_dir):
    key = F.col("o_orderkey")
    seconds, quotient, count = (key * 37 % 20000).cast("string"), key % 40 / 4 + key % 7, key * 7919 % 3000000007
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", formats.hours(F.concat(F.lit(" "), seconds, F.lit("s"))).alias("hms"), formats.hours(seconds, hide_zero=True).alias("clock"), formats.ratio(quotient).alias("ratio"), formats.size(count).alias("size"))


_NUMBERS = ["12", " 3.5kg", "-4e1", "abc", "", "1e400", ".5", "7 ", "+08"]
_VALUES = ["12.0", "3.5", "-40.0", "0.0", "0.0", "0.0", "0.5", "7.0", "8.0"]
_WHOLE = [True, False, True, False, False, True, True, True, True]


@query(f"SELECT p_partkey, CAST({_cycled(_VALUES)} AS DOUBLE) AS value, {' OR '.join(f'p_partkey % {len(_NUMBERS)} = {i}' for i, w in enumerate(_WHOLE) if w)} AS whole FROM part")
def number_coercion(spark, sf_dir):
    """The number a text begins with, and whether all of it is one."""
    text = F.expr(_cycled(_NUMBERS))
    return table(spark, sf_dir, "part").select("p_partkey", formats.leading_number(text).alias("value"), formats.is_number(text).alias("whole"))


@query("""
WITH t AS (SELECT p_partkey, CAST(p_size * 173 AS BIGINT) AS w, CAST(p_partkey % 1500 AS BIGINT) AS h, p_partkey % 3 AS s FROM part),
 f AS (SELECT *, LEAST(1920.0 / NULLIF(w, 0), 1080.0 / NULLIF(h, 0)) AS down, CASE s WHEN 1 THEN 32.0 / 27 WHEN 2 THEN 8.0 / 9 ELSE 1.0 END AS sar FROM t),
 g AS (SELECT *, LEAST(1920.0 / NULLIF(w * sar, 0), 1080.0 / NULLIF(h, 0)) AS up FROM f)
SELECT p_partkey, CASE WHEN h > 0 AND down < 1 THEN GREATEST(CAST(FLOOR(w * down / 2 + 0.5) AS BIGINT) * 2, 2) ELSE w END AS cap_w, CASE WHEN h > 0 AND down < 1 THEN GREATEST(CAST(FLOOR(h * down / 2 + 0.5) AS BIGINT) * 2, 2) ELSE h END AS cap_h,
 CASE WHEN h > 0 AND up >= 1.1 THEN LEAST(GREATEST(CAST(FLOOR(w * sar * up / 2 + 0.5) AS BIGINT) * 2, 2), 1920) END AS big_w, CASE WHEN h > 0 AND up >= 1.1 THEN LEAST(GREATEST(CAST(FLOOR(h * up / 2 + 0.5) AS BIGINT) * 2, 2), 1080) END AS big_h FROM g""".replace("1920.0", "CAST(1920 AS DOUBLE)").replace("1080.0", "CAST(1080 AS DOUBLE)").replace("32.0 / 27", "CAST(32 AS DOUBLE) / 27").replace("8.0 / 9", "CAST(8 AS DOUBLE) / 9").replace("ELSE 1.0", "ELSE CAST(1 AS DOUBLE)"))
def resized(spark, sf_dir):
    key = F.col("p_partkey")
    w, h = (F.col("p_size") * 173).cast("bigint"), (key % 1500).cast("bigint")
    sar = F.when(key % 3 == 1, "32:27").when(key % 3 == 2, "8:9").otherwise("0:1")
    named = zip(("cap_w", "cap_h", "big_w", "big_h"), (*dimensions.capped(w, h, "1080p"), *dimensions.enlarged(w, h, "1080p", sar)), strict=True)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.cast("bigint").alias(n) for n, c in named])


_TRACKS = ["Audiokommentar", "Director's Comentary", "Audiosommentary", "Audio Descripcion", "M&E", "Isolated Score", "Interview", "Surround 5.1", "AD", "ad", "SDH", "English CC", "erzwungen", "Forcé", "accent", ""]
_AUDIO_SAID = ["commentary", "commentary", "commentary", "description", "effects", "score", "interview", "main", "description", "main", "main", "main", "main", "main", "main", "main"]
_SUBTITLE_SAID = ["commentary", "commentary", "commentary", "full", "full", "full", "full", "full", "full", "full", "sdh", "sdh", "forced", "forced", "full", "full"]


@query("WITH n(i, audio, subtitle) AS (VALUES " + ", ".join(f"({i}, '{a}', '{s}')" for i, (a, s) in enumerate(zip(_AUDIO_SAID, _SUBTITLE_SAID, strict=True))) + f""")
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'commentary' WHEN p_size % 5 = 0 AND audio <> 'commentary' THEN 'description' ELSE audio END AS audio, CASE WHEN p_size % 7 = 0 OR subtitle = 'commentary' THEN 'commentary' WHEN p_size % 5 = 0 THEN 'forced' WHEN p_size % 3 = 0 AND subtitle <> 'forced' THEN 'sdh' ELSE subtitle END AS subtitle
FROM part JOIN n ON p_partkey % {len(_TRACKS)} = i""")
def track_roles(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*[F.lit(t) for t in _TRACKS]), (F.col("p_partkey") % len(_TRACKS)).cast("int")).alias("name"))
    audio = tracks.audio_role(F.col("name"), size % 7 == 0, size % 5 == 0)
    return rows.select("p_partkey", audio.alias("audio"), tracks.subtitle_role(F.col("name"), size % 7 == 0, size % 5 == 0, size % 3 == 0).alias("subtitle"))


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 3 AS c, CAST(p_size % 3 * 2 + 4 AS VARCHAR) AS ch, p_partkey % 5 = 0 AS o, p_partkey % 7 = 0 AS x FROM part)
SELECT p_partkey, CASE WHEN c = 0 THEN CASE WHEN ch = '8' THEN CASE WHEN o THEN 100 ELSE 90 END WHEN ch = '6' THEN CASE WHEN o THEN 80 WHEN x THEN 65 ELSE 60 END END WHEN c = 1 THEN CASE WHEN ch = '8' THEN 70 WHEN ch = '6' THEN CASE WHEN x AND NOT o THEN 62 ELSE 50 END END END AS rung FROM t""")
def audio_ladder(spark, sf_dir):
    """Object and EX flags from what a probe or the name says, and the rung of the track."""
    key = F.col("p_partkey")
    codec = F.when(key % 3 == 0, "A_EAC3").when(key % 3 == 1, "a_ac3").otherwise("A_DTS")
    channels = (F.col("p_size") % 3 * 2 + 4).cast("string")
    objects = tracks.has_objects(F.when(key % 10 == 0, "Dolby Digital Plus with Dolby Atmos"), F.when(key % 5 == 0, "16").otherwise("0"), F.lit("Surround"))
    ex = tracks.is_ex(F.when(key % 14 == 0, "Dolby Surround EX").otherwise("Dolby Surround"), F.when(key % 7 == 0, "DD EX 5.1").otherwise("Dolby Express"))
    return table(spark, sf_dir, "part").select("p_partkey", tracks.ladder_score(codec, channels, objects, ex).alias("rung"))


_TAGS = [("eng", "", "en"), ("ger", "", "de"), ("und", "cmn-Hans", "zh"), ("yue", "", "zh"), ("", "nb-NO", "no"), ("zxx", "und", ""), ("fre", "fr-CA", "fr"), ("qqq", "", "qqq"), ("hrv", "", "sh")]


@query("WITH t(i, spoken) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, _, c) in enumerate(_TAGS)) + f") SELECT p_partkey, spoken FROM part JOIN t ON p_partkey % {len(_TAGS)} = i")
def track_languages(spark, sf_dir):
    """Any spelling of a language's code, families of languages as one."""
    key = (F.col("p_partkey") % len(_TAGS)).cast("int")
    tags = table(spark, sf_dir, "part").select("p_partkey", *[F.get(F.array(*[F.lit(t[n]) for t in _TAGS]), key).alias(c) for n, c in enumerate(("tag", "ietf"))])
    known = spark.createDataFrame([("en", "eng", "eng"), ("de", "deu", "ger"), ("fr", "fra", "fre"), ("zh", "zho", "chi"), ("no", "nor", "nor")], "code2 string, code3 string, bibliographic string")
    return tracks.with_language(tags, known, "tag", "ietf").select("p_partkey", "spoken")


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])((?i:api[_-]?key|access[_-]?token|auth[_-]?token|token|password|passwd|secret)\s*[=:]\s*)([^\s&"'',;]+)', '***', 'g'), '((?i:--(?:api-?key|token|password|secret)\s+))(\S+)', '***', 'g'), '(^|[^\p{L}\p{N}_])((?i:authorization\s*:\s*\w+\s+))(\S+)', '***', 'g')) AS md5 FROM documents WHERE text IS NOT NULL""")
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(files.redacted(F.col("text"))).alias("md5"))


_LINES = ["Error while decoding stream #0:1", "moov atom not found", "bad CRC 12", "No space left on device", "CUDA out of memory", "Permission denied", "HTTP Error 429: Too Many Requests", "Connection timed out", "all is well", "Output file #0 does not contain any stream"]
_LINE_SAYS = ["decode-error", "invalid-data", "archive-damaged", "disk-full", "out-of-memory", "permission", "blocked", "network", "", "empty-output"]


@query(f"SELECT p_partkey, {_cycled(_LINE_SAYS)} AS cause FROM part")
def line_causes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", files.first_of(F.concat(F.lit("[x] "), F.expr(_cycled(_LINES)), F.lit("."))).alias("cause"))


@query("""
WITH t AS (SELECT p_partkey, CAST(p_size * 100000 AS BIGINT) AS size, p_partkey % 4 AS c, p_partkey % 3 AS k, CAST(p_size AS DOUBLE) AS s FROM part),
 a AS (SELECT *, CASE c WHEN 0 THEN 0 WHEN 1 THEN 96000 WHEN 2 THEN 6 * 64000 ELSE 2 * 64000 END AS audio FROM t)
SELECT p_partkey, CASE k WHEN 1 THEN CAST(p_partkey * 100 // 1000 AS BIGINT) ELSE CASE WHEN FLOOR((size * 8 / s - audio) * 0.98 / 1000) > 0 OR (size * 8 / s - audio) * 0.98 > 0 THEN CAST(FLOOR((size * 8 / s - audio) * 0.98 / 1000) AS BIGINT) END END AS kbit,
 CASE k WHEN 1 THEN 'stated' ELSE 'estimated' END AS origin, CAST(CASE WHEN c = 0 THEN 0 ELSE 1 END AS INTEGER) AS sounds, 'matroska' AS container, CASE p_partkey % 2 WHEN 0 THEN 'HDR10' ELSE 'SDR' END AS range FROM a""")
def probe_documents(spark, sf_dir):
    """Probe documents are written as JSON and read back as census columns; cover pictures are no video."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    cover = F.struct(F.lit("video").alias("codec_type"), F.lit("mjpeg").alias("codec_name"), F.lit("").alias("color_transfer"), F.lit(None).cast("string").alias("bit_rate"), F.lit(None).cast("int").alias("channels"), F.struct(F.lit(1).alias("attached_pic")).alias("disposition"), F.lit(None).cast("map<string,string>").alias("tags"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("hevc").alias("codec_name"), F.when(key % 2 == 0, "smpte2084").otherwise("bt709").alias("color_transfer"), F.lit(None).cast("string").alias("bit_rate"), F.lit(None).cast("int").alias("channels"), F.struct(F.lit(0).alias("attached_pic")).alias("disposition"), F.when(key % 3 == 1, F.create_map(F.lit("BPS-eng"), text(key * 100))).alias("tags"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("").alias("color_transfer"), F.when(key % 4 == 1, "96000").alias("bit_rate"), F.when(key % 4 == 2, 6).alias("channels"), F.struct(F.lit(0).alias("attached_pic")).alias("disposition"), F.lit(None).cast("map<string,string>").alias("tags"))
    streams = F.when(key % 4 == 0, F.array(cover, video)).otherwise(F.array(cover, video, sound))
    form = F.struct(F.lit("matroska,webm").alias("format_name"), text(size).alias("duration"), text(size.cast("bigint") * 100000).alias("size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("a/b.mkv").alias("path"), F.to_json(F.struct(streams.alias("streams"), form.alias("format"))).alias("doc"))
    told = probe.probed(rows, "path", "doc")
    return told.select("p_partkey", F.col("videoKbit").alias("kbit"), F.col("videoRateOrigin").alias("origin"), F.col("audioTracks").alias("sounds"), "container", F.col("dynamicRange").alias("range"))


@query("SELECT o_orderkey, COALESCE(ABS(s - o) <= GREATEST(1.0, s * 0.01), false) AS matches FROM (SELECT o_orderkey, CAST(o_orderkey % 500 + 1 AS DOUBLE) AS s, CAST(o_orderkey % 500 + o_orderkey % 13 AS DOUBLE) AS o FROM orders)")
def length_match(spark, sf_dir):
    key = F.col("o_orderkey")
    s, o = (key % 500 + 1).cast("double"), (key % 500 + key % 13).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", dimensions.length_matches(s, o).alias("matches"))


# --- joins, sets and lookups ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, COUNT(*) AS orders, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def titles_join(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.count(F.lit(1)).alias("orders"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def titles_semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_name AS title FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part")
def titles_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("title")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"))]
    return cubes.union_all(parts).distinct()


_FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT DISTINCT p_partkey, replace({_FOLD.format('p_name')}, ' ', '') AS key FROM part WHERE p_name IS NOT NULL")
def exact_key(spark, sf_dir):
    key = F.replace(titles.fold_ascii(F.col("p_name")), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", key.alias("key")).distinct()


_NEAR = f"SELECT DISTINCT replace({_FOLD.format('p_name')}, ' ', '') AS key FROM part"
_SLIPPED = "SELECT DISTINCT CASE length(key) % 3 WHEN 0 THEN substr(key, 1, 3) || substr(key, 5) WHEN 1 THEN substr(key, 1, 2) || substr(key, 4, 1) || substr(key, 3, 1) || substr(key, 5) ELSE key || 's' END AS key"


@query(f"WITH k AS ({_NEAR}), s AS ({_SLIPPED} FROM k) SELECT DISTINCT s.key AS left_key, k.key AS right_key FROM s JOIN k ON damerau_levenshtein(s.key, k.key) = 1 AND least(length(s.key), length(k.key)) >= 6")
def near_key(spark, sf_dir):
    key = F.replace(titles.fold_ascii(F.col("p_name")), F.lit(" "), F.lit("")).alias("key")
    keys = table(spark, sf_dir, "part").select(key).distinct()
    slipped = keys.select(F.expr(_SLIPPED.removeprefix("SELECT DISTINCT ").removesuffix(" AS key")).alias("key")).distinct()
    return linkage.near_join(slipped, keys, "key")


# --- text ----------------------------------------------------------------------------------------------------------


_STOP = ", ".join(f"'{w}'" for w in mining.FRAGMENT_STOP_WORDS)


@query(f"SELECT token, COUNT(*) AS names FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'))) AS token FROM part) WHERE length(token) > 1 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({_STOP}) GROUP BY token HAVING COUNT(*) >= 2")
def prevalence_part(spark, sf_dir):
    """Names with an extension each (.k0 to .k9), which does not count."""
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type", F.lit(".K"), (F.col("p_size") % 10).cast("string")).alias("name"))
    return mining.prevalence(rows, "name", ascii_only=True, ordered=False)


@query(f"SELECT token, COUNT(*) AS names FROM (SELECT unnest(list_distinct(regexp_split_to_array(regexp_replace(lower(text), '\\.[a-z][a-z0-9]{{0,3}}$', ''), '[^a-z0-9]+'))) AS token FROM documents) WHERE length(token) > 1 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({_STOP}) GROUP BY token HAVING COUNT(*) >= 2")
def prevalence_documents(spark, sf_dir):
    return mining.prevalence(table(spark, sf_dir, "documents"), "text", ascii_only=True, ordered=False)


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS r FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS p FROM orders GROUP BY 1, 2)) WHERE r = 1")
def plurality_first_seen(spark, sf_dir):
    return mining.plurality(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters FROM documents")
def text_counts(spark, sf_dir):
    words, characters = mining.text_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), characters.alias("characters"))


_SCORES = ", ".join("{{'neg': -CAST(len(list_filter(w, lambda x: x IN ({0}))) AS DOUBLE) / NULLIF(len(w), 0), 'ord': {1}, 'code': '{2}'}}".format(", ".join(f"'{x}'" for x in words.split()), i, code) for i, (code, words) in enumerate(mining.LANGUAGE_WORDS.items()))


_SCRIPTS = " ".join(f"WHEN letters > 0 AND len(regexp_extract_all(b, '{p}')) >= letters * 0.15 THEN '{c}'" for c, p in mining.SCRIPTS)


@query(rf"""
WITH b AS (SELECT doc_id, lower(COALESCE(text, '')) AS b FROM documents),
 t AS (SELECT doc_id, b, len(regexp_extract_all(b, '\p{{L}}')) AS letters, list_filter(regexp_split_to_array(b, '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM b),
 s AS (SELECT doc_id, CASE {_SCRIPTS} END AS script, list_sort([{_SCORES}]) AS r FROM t)
SELECT doc_id, CASE WHEN script IS NOT NULL THEN script WHEN -r[1].neg >= 0.04 THEN r[1].code ELSE '' END AS code, script IS NULL AND COALESCE(-r[1].neg >= 0.04 AND -r[2].neg >= 0.04 AND -r[2].neg >= -r[1].neg * 0.55, false) AS ambiguous FROM s""")
def language_score(spark, sf_dir):
    return mining.language(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT role, CAST(COUNT(*) FILTER (WHERE length(text) > 100) AS DOUBLE) / COUNT(*) AS share FROM conversations GROUP BY role")
def share_test(spark, sf_dir):
    return mining.share(table(spark, sf_dir, "conversations"), ["role"], F.length("text") > 100)


# --- gaps ----------------------------------------------------------------------------------------------------------

_RUN = """
WITH d AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS v FROM lineitem WHERE l_linenumber > 0),
 r AS (SELECT l_orderkey, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi FROM d GROUP BY 1 HAVING COUNT(*) >= 2),
 s AS (SELECT l_orderkey, hi, CASE WHEN n / hi >= 0.5 THEN 1 WHEN n >= 3 AND n / (hi - lo + 1) >= 0.75 THEN CASE WHEN (lo >= 1900 AND hi <= 2099) OR (lo > 100 AND lo % 100 = 1 AND lo // 100 = hi // 100) THEN lo ELSE 1 END END AS st FROM r),
 e AS (SELECT l_orderkey, unnest(range(st, hi)) AS v FROM s WHERE st IS NOT NULL)
SELECT e.l_orderkey, e.v AS l_linenumber FROM e ANTI JOIN d ON e.l_orderkey = d.l_orderkey AND e.v = d.v"""


@query(_RUN)
def missing_linenumbers(spark, sf_dir):
    return gaps.missing_numbers(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, MIN(v) AS first, MAX(v) AS last FROM (SELECT l_orderkey, v, v - ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY v) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS v FROM lineitem)) GROUP BY l_orderkey, g")
def islands(spark, sf_dir):
    return gaps.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
 g AS (SELECT o_custkey, d, LAG(d) OVER (PARTITION BY o_custkey ORDER BY d) AS b FROM d),
 s AS (SELECT *, date_diff('day', b, d) AS st FROM g WHERE b IS NOT NULL),
 m AS (SELECT o_custkey, median(st) AS u FROM s GROUP BY 1 HAVING COUNT(*) >= 3),
 l AS (SELECT *, CASE WHEN u <= 2 THEN 'daily' WHEN u <= 10 THEN 'weekly' WHEN u <= 45 THEN 'monthly' ELSE printf('every %d days or so', CAST(round_even(u, 0) AS INT)) END AS cadence, CASE WHEN u <= 2 THEN 7 WHEN u <= 10 THEN 30 WHEN u <= 45 THEN 75 ELSE FLOOR(2 * u) END AS most FROM m)
SELECT o_custkey, CAST(b + 1 AS DATE) AS first, CAST(d - 1 AS DATE) AS last, CAST(st - 1 AS INTEGER) AS days, cadence FROM s JOIN l USING (o_custkey) WHERE st - 1 >= most""")
def cadence_gaps(spark, sf_dir):
    return gaps.cadence_gaps(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


# --- intervals -----------------------------------------------------------------------------------------------------

_SPANS = "SELECT user_id, epoch(ts) AS a, epoch(ts) + value * 60 AS b FROM events WHERE value > 0"
_UNION = f"""
WITH i AS (SELECT user_id, CAST(floor(a) AS BIGINT) AS a, CAST(floor(b) AS BIGINT) AS b FROM ({_SPANS})),
 p AS (SELECT *, MAX(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i WHERE b > a),
 q AS (SELECT *, SUM(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p),
 u AS (SELECT user_id, MIN(a) AS a, MAX(b) AS b FROM q GROUP BY user_id, g)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").where("value > 0")
    return rows.select("user_id", F.floor(seconds).alias("a"), F.floor(seconds + F.col("value") * 60).alias("b"))


@query(f'{_UNION} SELECT user_id, a AS start, b AS "end" FROM u')
def interval_union(spark, sf_dir):
    return intervals.interval_union(_spans(spark, sf_dir), ["user_id"], "a", "b")


@query(f"{_UNION} SELECT user_id, CAST(SUM(b - a) AS BIGINT) AS total FROM u GROUP BY user_id")
def wall_clock(spark, sf_dir):
    return intervals.wall_clock(_spans(spark, sf_dir), ["user_id"], "a", "b")


@query(f"""{_UNION}, c AS (SELECT user_id, COALESCE(LAG(b) OVER (PARTITION BY user_id ORDER BY a), 1704067200) AS s, a AS e FROM u UNION ALL SELECT user_id, MAX(b), 1706659200 FROM u GROUP BY user_id)
SELECT user_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM c WHERE e - s > 60""")
def complement(spark, sf_dir):
    low, high = F.lit(1704067200).cast("bigint"), F.lit(1706659200).cast("bigint")
    return intervals.complement(_spans(spark, sf_dir), ["user_id"], "a", "b", low, high, least=60)


@query("SELECT conv_id, turn, CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def cumulative_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("len", F.length("text").cast("bigint"))
    return intervals.cumulative_offset(rows, ["conv_id"], "turn", "len").select("conv_id", "turn", "offset")


_KEPT = "SELECT user_id, a, b FROM u"


@query(f"""{_UNION}, k AS (SELECT user_id, a, b, COALESCE(SUM(b - a) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh FROM u),
 m AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) + 30 AS t FROM events),
 j AS (SELECT m.event_id, m.user_id, m.t, k.a, k.sh, ROW_NUMBER() OVER (PARTITION BY m.event_id ORDER BY k.a) AS r FROM m JOIN k ON m.user_id = k.user_id AND k.b > m.t)
SELECT event_id, CAST(sh + GREATEST(t - a, 0) AS BIGINT) AS moved FROM j WHERE r = 1""")
def remap(spark, sf_dir):
    kept = intervals.interval_union(_spans(spark, sf_dir), ["user_id"], "a", "b")
    marks = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) + 30).alias("t"))
    return intervals.remap(marks, kept, ["user_id"], "t", "start", "end").select("event_id", "moved")


@query(r"""
WITH t AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS w FROM conversations),
 l AS (SELECT *, COALESCE(LAG(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS p FROM t)
SELECT conv_id, turn, CAST(len(list_filter(w, lambda x: NOT list_contains(p, x))) AS INTEGER) AS fresh FROM l""")
def rolling_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    return intervals.rolling_dedupe(rows, ["conv_id"], "turn", "w").select("conv_id", "turn", F.size("w").alias("fresh"))


@query("SELECT l_orderkey, bool_and(up) AS increasing FROM (SELECT l_orderkey, COALESCE(l_shipdate > LAG(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), true) AS up FROM lineitem) GROUP BY 1")
def strictly_increasing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return intervals.strictly_increasing(rows, ["l_orderkey"], "o", "l_shipdate")


@query("SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ordinal, lpad(CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), CAST(length(CAST(COUNT(*) OVER (PARTITION BY o_custkey) AS VARCHAR)) AS INT), '0') AS numbered FROM orders")
def ordinal_numbering(spark, sf_dir):
    return intervals.ordinal(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.col("o_orderkey"))


# --- choices and planning ------------------------------------------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def best_per_key(spark, sf_dir):
    return sync.best_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.struct("o_totalprice", "o_orderkey"))


@query("""
WITH a AS (SELECT o_custkey, MAX(o_totalprice) AS left_best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, MAX(o_totalprice) AS right_best FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, left_best, right_best, CASE WHEN left_best IS NULL THEN 'right' WHEN right_best IS NULL THEN 'left' WHEN left_best > right_best THEN 'left' WHEN left_best < right_best THEN 'right' ELSE 'equal' END AS better FROM a FULL JOIN b USING (o_custkey)""")
def compared_sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return sync.compared(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_custkey"], "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_watchlist(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return sync.not_in_any(table(spark, sf_dir, "customer").select("c_custkey"), [orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 400000")], "c_custkey")


@query("""
WITH k AS (SELECT c_custkey AS id, ['1990-01-01'] AS days, c_nationkey AS rating FROM customer),
 n AS (SELECT o_custkey AS id, list(strftime(o_orderdate, '%Y-%m-%d')) AS days, MAX(CAST(o_totalprice AS INT) % 10) AS rating FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(COALESCE(k.days, []), COALESCE(n.days, [])))), '|') AS days, COALESCE(n.rating, k.rating) AS rating FROM k FULL JOIN n USING (id)""".replace("CAST(o_totalprice AS INT)", "CAST(floor(o_totalprice) AS INT)"))
def upsert_merge(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("1990-01-01")).alias("days"), F.col("c_nationkey").alias("rating"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("days"), (F.floor("o_totalprice").cast("int") % 10).alias("rating"))
    return sync.upsert(known, new, "id", "days", "rating").withColumn("days", F.array_join("days", "|"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'confirmed' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'offer' ELSE 'wait' END AS state FROM orders")
def pending(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sync.pending(orders, lines, "o_orderkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "state")


@query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS rewatch FROM orders")
def rewatches(spark, sf_dir):
    plays = table(spark, sf_dir, "orders").withColumn("day", F.struct("o_orderdate", "o_orderkey"))
    return sync.rewatches(plays, "o_custkey", "day").select("o_orderkey", "rewatch")


@query("""
WITH f AS (SELECT l_partkey, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 3),
 w AS (SELECT l_partkey, MAX(ABS(l_extendedprice - slope * l_quantity - intercept)) AS off FROM lineitem JOIN f USING (l_partkey) GROUP BY 1)
SELECT l_partkey, ROUND(slope, 3) AS slope, ROUND(intercept, 1) AS intercept FROM f JOIN w USING (l_partkey) WHERE off <= 50000""")
def regression(spark, sf_dir):
    """A line per part; parts with a point that is far from theirs have none."""
    fit = curves.straight_line(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice", most=50000.0)
    return fit.select("l_partkey", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query("SELECT o_custkey, o_totalprice AS median FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = n // 2 + 1")
def upper_median(spark, sf_dir):
    return curves.upper_median(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")


@query("SELECT p_partkey, ROUND(CASE WHEN x <= 5 THEN 10.0 WHEN x >= 45 THEN 3.0 WHEN x <= 20 THEN 10.0 + (x - 5) * (6.0 - 10.0) / 15 ELSE 6.0 + (x - 20) * (3.0 - 6.0) / 25 END, 6) AS y, ROUND(CASE WHEN x <= 20 THEN 10.0 + (x - 5) * (6.0 - 10.0) / 15 ELSE 6.0 + (x - 20) * (3.0 - 6.0) / 25 END, 6) AS beyond FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
def interpolated(spark, sf_dir):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((5.0, 10.0), (20.0, 6.0), (45.0, 3.0))])
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(curves.interpolate(points, x), 6).alias("y"), F.round(curves.interpolate(points, x, clamp=False), 6).alias("beyond"))


_CURVES = "SELECT 'old' AS road, r_regionkey * 10.0 + 50 AS score, pow(2.0, r_regionkey) AS size FROM region UNION ALL SELECT 'new', r_regionkey * 9.0 + 52, pow(2.0, r_regionkey) * (0.4 + 0.05 * r_regionkey) FROM region"


@query(f"""
WITH c AS (SELECT road, CAST(score AS DOUBLE) AS x, ln(CAST(size AS DOUBLE)) AS y FROM ({_CURVES})),
 ends AS (SELECT MAX(lo) AS lo, MIN(hi) AS hi FROM (SELECT road, MIN(x) AS lo, MAX(x) AS hi FROM c GROUP BY road)),
 grid AS (SELECT i, lo + (hi - lo) * i / 200 AS x FROM ends, range(201) t(i)),
 part_of AS (SELECT *, lead(x) OVER (PARTITION BY road ORDER BY x) AS x2, lead(y) OVER (PARTITION BY road ORDER BY x) AS y2 FROM c),
 at_grid AS (SELECT i, road, MIN(y + (grid.x - part_of.x) * (y2 - y) / (x2 - part_of.x)) AS v FROM grid JOIN part_of ON grid.x BETWEEN part_of.x AND x2 GROUP BY 1, 2)
SELECT ROUND(exp(AVG(CASE WHEN road = 'new' THEN v ELSE -v END) * 2) - 1, 6) AS rate FROM at_grid""")
def bd_rate(spark, sf_dir):
    """Sizes at equal scores of two roads, over the scores that both reach."""
    table(spark, sf_dir, "region").createOrReplaceTempView("cataloom_region")
    return curves.bd_rate(spark.sql(_CURVES.replace("FROM region", "FROM cataloom_region")), "road", "old", "new").select(F.round("rate", 6).alias("rate"))


@query("""
SELECT o_custkey, o_orderstatus, COUNT(*) AS requests, ROUND(SUM(o_totalprice), 2) AS seconds, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS tokens, COUNT(n) AS counted, ROUND(COALESCE(SUM(CASE WHEN n IS NOT NULL THEN o_totalprice END), 0), 2) AS counted_seconds,
 CAST(COALESCE(SUM(CASE WHEN n IS NOT NULL THEN o_orderkey % 5 END), 0) AS BIGINT) AS read, ROUND(COALESCE(SUM(n), 0) / NULLIF(SUM(CASE WHEN n IS NOT NULL THEN o_totalprice END), 0), 9) AS rate
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1000 END AS n FROM orders) GROUP BY o_custkey, o_orderstatus""")
def tally_merge(spark, sf_dir):
    """Tallies by priority first, then merged: the order of merging does not matter."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"n": F.when(key % 3 > 0, key % 1000), "r": key % 5})
    parts = tallies.tally(rows, ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_totalprice", "n", "r").drop("rate")
    whole = tallies.merged(parts, ["o_custkey", "o_orderstatus"])
    return whole.withColumns({"seconds": F.round("seconds", 2), "counted_seconds": F.round("counted_seconds", 2), "rate": F.round("rate", 9)})


@query("""
SELECT o_custkey, CAST(SUM(n) AS BIGINT) AS files, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN FLOOR(o_totalprice) ELSE COALESCE(b, 0) END) AS BIGINT) AS bytes
FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(CASE WHEN l_partkey % 7 > 0 THEN l_partkey * 10 END) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def run_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "manifest"})
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey") * 10).alias("bytes"))
    measured = orders.where("o_orderstatus = 'F'").select("o_custkey", "manifest", F.floor("o_totalprice").alias("bytes"))
    return tallies.run_totals(lines.join(orders.select("o_custkey", "manifest"), "manifest"), measured, ["o_custkey"], "manifest", "bytes")


@query(f"SELECT film, COUNT(*) AS copies FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'match|' || (p_partkey % 50) ELSE 'own|' || {_FOLD.format('p_name')} || '|' || p_size END AS film FROM part) GROUP BY 1")
def grouped_copies(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 50).alias("m"), titles.fold_ascii(F.col("p_name")).alias("f"), "p_size")
    return tallies.copies(rows, "m", "f", "p_size").groupBy("film").agg(F.count(F.lit(1)).alias("copies"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber * 4 AS x, CAST(l_quantity AS BIGINT) + 9 AS y, 600 - l_linenumber * 7 AS w, 400 - CAST(l_quantity AS BIGINT) * 2 AS h FROM lineitem),
 b AS (SELECT l_orderkey, MIN(LEAST(GREATEST(y, 0), GREATEST(400 - h - y, 0))) AS v, MIN(LEAST(GREATEST(x, 0), GREATEST(600 - w - x, 0))) AS u FROM r GROUP BY 1),
 e AS (SELECT l_orderkey, v - v % 2 AS v, u - u % 2 AS u FROM b),
 k AS (SELECT l_orderkey, CASE WHEN v < 8 THEN 0 ELSE v END AS v, CASE WHEN u < 8 THEN 0 ELSE u END AS u FROM e)
SELECT l_orderkey, CAST(600 - 2 * u AS BIGINT) AS crop_w, CAST(400 - 2 * v AS BIGINT) AS crop_h, CAST(u AS BIGINT) AS crop_x, CAST(v AS BIGINT) AS crop_y FROM k WHERE u > 0 OR v > 0""")
def common_crop(spark, sf_dir):
    n, q = F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint")
    rects = table(spark, sf_dir, "lineitem").select("l_orderkey", (n * 4).alias("x"), (q + 9).alias("y"), (600 - n * 7).alias("w"), (400 - q * 2).alias("h"), F.lit(600).cast("bigint").alias("fw"), F.lit(400).cast("bigint").alias("fh"))
    return tallies.common_crop(rects, ["l_orderkey"], "x", "y", "w", "h", "fw", "fh")


@query("""
WITH f AS (SELECT user_id, epoch(ts) AS t, event_type = 'signup' AS black, value, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS b FROM events),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ABS(t - 1705000000), t) AS r FROM f WHERE b IS NOT NULL AND (black OR value >= 50))
SELECT user_id, ROUND((b + t) / 2, 3) AS cut, CASE WHEN black THEN 'black' ELSE 'scene' END AS kind FROM k WHERE r = 1""")
def cut_midpoint(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") == "signup").alias("black"), "value")
    found = tallies.nearest_cut(frames, ["user_id"], "t", "black", "value", F.lit(1705000000.0), 50.0)
    return found.withColumn("cut", F.round("cut", 3))


@query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 8 AS asked, COUNT(*) OVER (PARTITION BY o_custkey) > 8 AS over FROM orders")
def bounded_candidates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tallies.bounded(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8).select("o_orderkey", "asked", "over")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY (o_orderstatus, o_orderpriority) = MIN((o_orderstatus, o_orderpriority)) OVER (PARTITION BY o_custkey)".replace("(o_orderstatus, o_orderpriority) = MIN((o_orderstatus, o_orderpriority))", "o_orderstatus || '|' || o_orderpriority = MIN(o_orderstatus || '|' || o_orderpriority)"))
def best_evidence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return tallies.best_evidence(orders, ["o_custkey"], [F.col("o_orderstatus"), F.col("o_orderpriority")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey LIMIT 25)")
def priority_cap(spark, sf_dir):
    """The 25 runs to ask about (a cap is what the operator is for)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return tallies.chosen_first(orders, [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.col("o_orderpriority")], "o_orderkey", 25).select("o_orderkey")


@query("SELECT DISTINCT 'https://' || split_part(substr(url, 9), '/', 1) || '/' || split_part(substr(url, 9), '/', 2) AS folder FROM pages WHERE starts_with(url, 'https://') AND len(string_split(substr(url, 9), '/')) > 2")
def folders_at_depth(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url like 'https://%'").select(F.concat(F.lit("/"), F.substring("url", 9, 4000)).alias("path"))
    found = census.folders_at(pages, "path", "", 2)
    return found.select(F.concat(F.lit("https:/"), "folder").alias("folder"))


_NAMED = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Show S' || lpad(CAST(o_orderkey % 3 + 1 AS STRING), 2, '0') || 'E' || lpad(CAST(o_orderkey % 17 AS STRING), 2, '0') || '.mkv' WHEN 1 THEN 'x ' || CAST(o_orderkey % 2 + 2 AS STRING) || 'x' || lpad(CAST(o_orderkey % 9 + 1 AS STRING), 2, '0') WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'notes' ELSE 'S04E' || CAST(o_orderkey % 5 AS STRING) || ' end' END ELSE CASE WHEN o_custkey % 5 = 0 THEN 'cover' ELSE 'S02E05' END END"
_SHOW = "CASE WHEN o_custkey % 2 = 0 THEN 'shows/Show ' || CAST(o_custkey AS STRING) ELSE 'shows/' || CAST(o_custkey AS STRING) || ' Season 3' END"


@query(f"""
WITH n AS (SELECT {_SHOW} AS folder, o_custkey % 2 = 1 AS one, {_NAMED} AS name FROM orders),
 e AS (SELECT *, regexp_extract(name, 'S([0-9]+)E([0-9]+)', ['s', 'e']) AS a, regexp_extract(name, '([0-9]+)x([0-9]+)', ['s', 'e']) AS b FROM n),
 m AS (SELECT folder, one, TRY_CAST(COALESCE(NULLIF(a.s, ''), b.s) AS INT) AS season, TRY_CAST(COALESCE(NULLIF(a.e, ''), b.e) AS INT) AS episode FROM e),
 k AS (SELECT folder FROM m GROUP BY 1 HAVING COUNT(season) >= LEAST(2, COUNT(*)) AND COUNT(season) * 2 >= COUNT(*)),
 d AS (SELECT DISTINCT folder, one, season, episode FROM m JOIN k USING (folder) WHERE season IS NOT NULL),
 h AS (SELECT folder, season, unnest(range(1, MAX(episode))) AS episode FROM d GROUP BY 1, 2),
 w AS (SELECT folder, unnest(range(CASE WHEN one THEN MIN(season) ELSE 1 END, MAX(season))) AS season FROM d WHERE season > 0 GROUP BY folder, one)
SELECT folder, CAST(season AS INTEGER) AS season, CAST(episode AS INTEGER) AS episode FROM h ANTI JOIN d USING (folder, season, episode) UNION ALL SELECT folder, CAST(season AS INTEGER), NULL FROM w ANTI JOIN d USING (folder, season)""")
def episode_gaps(spark, sf_dir):
    """Names made of orders: episodes in two notations, a season's own folder, folders that hold other things."""
    names = table(spark, sf_dir, "orders").select(F.expr(_SHOW).alias("folder"), F.expr(_NAMED).alias("name"))
    return gaps.episode_gaps(names)


@query("""
WITH s AS (SELECT user_id, event_id % 5 AS part, epoch(ts) AS a, epoch(ts) + value AS b FROM events WHERE value > 0),
 t AS (SELECT *, MAX(b) OVER (PARTITION BY user_id, part ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
 g AS (SELECT user_id, part FROM t GROUP BY 1, 2 HAVING NOT bool_or(COALESCE(a < r, false)) AND SUM(b - a) <= 1000 * 0.4)
SELECT user_id, part, COUNT(*) AS spans FROM s JOIN g USING (user_id, part) GROUP BY 1, 2""")
def accepted_spans(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").where("value > 0").select("user_id", (F.col("event_id") % 5).alias("part"), start.alias("a"), (start + F.col("value")).alias("b"), F.lit(1000.0).alias("total"))
    return intervals.accepted_spans(rows, ["user_id", "part"], "a", "b", "total", 0.4).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("spans"))


@query("""
WITH v AS (SELECT o_custkey, o_totalprice % 1000 AS a FROM orders), w AS (SELECT c_custkey AS k, c_acctbal % 1000 AS u FROM customer)
SELECT o_custkey, ROUND(a, 4) AS a, ROUND(u, 4) AS nearest FROM v JOIN w ON o_custkey = k AND ABS(u - a) <= 100""")
def nearest_match(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") % 1000).alias("a"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") % 1000).alias("u"))
    found = intervals.nearest(left, right, ["o_custkey"], "a", "u", 100.0)
    return found.select("o_custkey", F.round("a", 4).alias("a"), F.round("nearest", 4).alias("nearest"))


_PARTS = "SELECT p_partkey AS id, p_name || ' ' || p_type AS t, p_size AS y FROM part"


@query(f"""
WITH o AS ({_PARTS}), l AS (SELECT id, lower(t) AS t, y FROM o), r AS (SELECT id, lower(replace(t, 'a', 'e')) AS t, y FROM o),
 p AS (SELECT l.id AS a, r.id AS b, l.t = r.t AS same, CASE WHEN l.t = r.t AND l.y = r.y THEN 2 WHEN l.t = r.t THEN 3
   WHEN l.y = r.y AND (starts_with(l.t, r.t || ' ') OR ends_with(l.t, ' ' || r.t) OR starts_with(r.t, l.t || ' ') OR ends_with(r.t, ' ' || l.t)) AND LEAST(len(string_split(l.t, ' ')), len(string_split(r.t, ' '))) >= 3 THEN 5
   WHEN l.y = r.y AND damerau_levenshtein(replace(l.t, ' ', ''), replace(r.t, ' ', '')) = 1 AND LEAST(length(replace(l.t, ' ', '')), length(replace(r.t, ' ', ''))) >= 6 THEN 6 END AS rung FROM l JOIN r ON ABS(l.y - r.y) <= 1),
 q AS (SELECT * FROM p WHERE rung IS NOT NULL),
 f AS (SELECT a, rung, list(b ORDER BY b) AS every, list(b ORDER BY b) FILTER (WHERE same) AS equal FROM (SELECT * FROM q QUALIFY rung = MIN(rung) OVER (PARTITION BY a)) GROUP BY a, rung),
 g AS (SELECT b, list(a ORDER BY a) AS every, list(a ORDER BY a) FILTER (WHERE same) AS equal FROM (SELECT * FROM q QUALIFY rung = MIN(rung) OVER (PARTITION BY b)) GROUP BY b),
 forth AS (SELECT a AS left_id, rung, CASE WHEN len(every) = 1 THEN every[1] WHEN len(equal) = 1 THEN equal[1] END AS right_id FROM f),
 back AS (SELECT b AS right_id, unnest(CASE WHEN len(every) = 1 THEN every WHEN len(equal) = 1 THEN equal ELSE every END) AS left_id FROM g)
SELECT left_id, right_id, rung FROM forth SEMI JOIN back USING (left_id, right_id)""")
def mutual_match(spark, sf_dir):
    """All parts linked to slightly misspelled names of all parts, by every rung."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_size").alias("year"), F.array(F.concat(F.lit("brand:"), F.col("p_partkey").cast("string"))).alias("ids"))
    right = rows.withColumns({"title": F.regexp_replace("title", "a", "e"), "ids": F.array().cast("array<string>")})
    return linkage.mutual_records(rows, right)
