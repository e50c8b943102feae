"""Columns that turn raw census values into dimensions: never null, few values, sortable as text."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Ladders and tables that results depend on.
RESOLUTIONS = (("720p", 1280, 720), ("1080p", 1920, 1080), ("1440p", 2560, 1440), ("2160p", 3840, 2160), ("4320p", 7680, 4320))
BELOW_LADDER = "SD"
BITRATE_BANDS = {
    "audio": ((36000, "<036kbps"), (48000, "<048kbps"), (80000, "<080kbps"), (120000, "<120kbps"), (250000, "<250kbps"), (750000, "<750kbps"), (None, ">750kbps")),
    "video": ((1000000, "<01.0Mbps"), (2500000, "<02.5Mbps"), (5000000, "<05.0Mbps"), (7500000, "<07.5Mbps"), (10000000, "<10.0Mbps"), (15000000, "<15.0Mbps"), (20000000, "<20.0Mbps"), (25000000, "<25.0Mbps"), (None, ">25.0Mbps")),
}
ASPECT_RATIOS = (
    (9, 16, "0.56"), (1, 1, "1.00"), (6, 5, "1.19"), (5, 4, "1.25"), (4, 3, "1.33"), (11, 8, "1.37"), (10, 7, "1.43"), (3, 2, "1.50"),
    (14, 9, "1.56"), (16, 10, "1.60"), (5, 3, "1.66"), (16, 9, "1.78"), (37, 20, "1.85"), (19, 10, "1.90"), (2, 1, "2.00"), (11, 5, "2.20"),
    (47, 20, "2.35"), (239, 100, "2.39"), (51, 20, "2.55"), (44, 17, "2.59"), (69, 25, "2.76"), (4, 1, "4.00"),
)
VIDEO_CODECS = (
    ("mpeg2", "mpeg2Era", ("mpeg2video", "mpeg1video")),
    ("intra", "mpeg2Era", ("prores", "dnxhd", "mjpeg", "ffv1", "huffyuv", "rawvideo", "dvvideo")),
    ("mpeg4", "mpeg4Era", ("mpeg4", "msmpeg4v1", "msmpeg4v2", "msmpeg4v3", "h263", "flv1", "rv40", "theora")),
    ("vc1", "modern", ("vc1", "wmv1", "wmv2", "wmv3")),
    ("vp8", "modern", ("vp8",)),
    ("h264", "modern", ("h264", "avc", "avc1", "x264")),
    ("vp9", "modern", ("vp9",)),
    ("hevc", "modern", ("hevc", "h265", "x265")),
    ("av1", "modern", ("av1",)),
    ("vvc", "modern", ("vvc", "h266")),
)
#: family, kind, extensions and aliases
IMAGE_FORMATS = (
    ("jpeg", "lossy", "jpg jpeg jpe jfif mjpeg mpo"),
    ("jpeg2000", "lossy", "jp2 j2k jpf jpx jpeg2000 j2c jpc"),
    ("webp", "lossy", "webp"),
    ("heic", "lossy", "heic heif hif heix mif1"),
    ("avif", "lossy", "avif avifs"),
    ("jxl", "lossy", "jxl jpegxl"),
    ("png", "lossless", "png apng png00 png24 png32"),
    ("tiff", "lossless", "tif tiff tiff64 ptif"),
    ("bmp", "lossless", "bmp dib bmp2 bmp3"),
    ("tga", "lossless", "tga targa"),
    ("pcx", "lossless", "pcx dcx"),
    ("netpbm", "lossless", "pnm ppm pgm pbm pam"),
    ("psd", "lossless", "psd psb"),
    ("gif", "palette", "gif gif87"),
    ("ico", "palette", "ico icon cur"),
    ("svg", "vector", "svg svgz msvg rsvg"),
)
RESIZE_LEAST = 1.1


def _cases(arms: Iterable[tuple[Column, str]], otherwise: str) -> Column:
    """First arm that holds wins."""
    out = None
    for condition, value in arms:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def folded(text: Column) -> Column:
    """Lower case that maps the dotted capital I to a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def text_dimension(text: Column) -> Column:
    return F.coalesce(F.nullif(folded(F.trim(text)), F.lit("")), F.lit(UNKNOWN))


def number_dimension(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit(UNKNOWN))


def library_dimension(file_name: Column, content: str) -> Column:
    """Report name without extension and without its leading content type (case counts)."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(stem, f"^{content}", ""), F.lit("")), F.lit(UNKNOWN))


def suffix_dimension(path: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit(UNKNOWN))


def dynamic_range(text: Column) -> Column:
    """DV before HDR, since a Dolby Vision file usually is an HDR file too."""
    upper = F.upper(text)
    return _cases(
        [
            (text.isNull() | (F.trim(text) == ""), UNKNOWN),
            (upper.contains("DOLBYVISION") | upper.contains("DOLBY VISION"), "DV"),
            (upper == "SDR", "SDR"),
            (upper.contains("HDR") | upper.contains("HLG") | upper.contains("PQ"), "HDR"),
        ],
        UNKNOWN,
    )


def high_frame_rate(fps: Column) -> Column:
    return _cases([(fps.isNull(), UNKNOWN), (fps > 30, "yes")], "no")


def bitrate_tier(rate: Column, ladder: str) -> Column:
    *bands, (_, top) = BITRATE_BANDS[ladder]
    return _cases([(rate.isNull(), UNKNOWN), *((rate < limit, label) for limit, label in bands)], top)


def resolution_tier(width: Column, height: Column) -> Column:
    """The highest tier that the width or the height reaches."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return _cases([(width.isNull() & height.isNull(), UNKNOWN), *(((w >= x) | (h >= y), name) for name, x, y in reversed(RESOLUTIONS))], BELOW_LADDER)


def width_tier(width: Column) -> Column:
    return _cases([(width.isNull(), UNKNOWN), *((width >= x, name) for name, x, _ in reversed(RESOLUTIONS))], BELOW_LADDER)


def aspect_bounds() -> list[tuple[str, float]]:
    """(label, upper bound): geometric means of neighbouring ratios, to six decimals."""
    pairs = zip(ASPECT_RATIOS, ASPECT_RATIOS[1:], strict=False)
    return [(f"{label}:1", round(math.sqrt(a / b * c / d), 6)) for (a, b, label), (c, d, _) in pairs]


def aspect_bucket(width: Column, height: Column) -> Column:
    ratio = width / height
    arms = [(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), UNKNOWN), *((ratio < bound, label) for label, bound in aspect_bounds())]
    return _cases(arms, f"{ASPECT_RATIOS[-1][2]}:1")


def lookup(key: Column, table: dict, otherwise: str | float) -> Column:
    """Value of a key in a small literal table; far less generated code than a CASE of the same size."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(otherwise))


def _codec_column(codec: Column, pick: int) -> Column:
    names = {}
    for row in VIDEO_CODECS:
        for name in (row[0], *row[2]):
            names.setdefault(name, row[pick])
    return lookup(folded(F.trim(codec)), names, UNKNOWN)


def codec_family(codec: Column) -> Column:
    return _codec_column(codec, 0)


def codec_era(codec: Column) -> Column:
    return _codec_column(codec, 1)


def _image_column(name: Column, pick: int) -> Column:
    names: dict[str, str] = {}
    for row in IMAGE_FORMATS:
        for alias in (row[0], *row[2].split()):
            names.setdefault(alias, row[pick])
    return lookup(F.regexp_replace(folded(F.trim(name)), r"^\.", ""), names, UNKNOWN)


def image_family(name: Column) -> Column:
    """The family of an extension (with its dot or without), a codec name or a delegate's name."""
    return _image_column(name, 0)


def image_kind(name: Column) -> Column:
    return _image_column(name, 1)


def _even(value: Column) -> Column:
    return F.greatest(F.floor(value / 2 + 0.5).cast("bigint") * 2, F.lit(2))


def capped(width: Column, height: Column, tier: str) -> tuple[Column, Column]:
    """A size scaled down to fit a tier, to even sides; one that fits, or is unreadable, as it is."""
    limits = {n: (w, h) for n, w, h in RESOLUTIONS}.get(tier)
    if limits is None:
        return width, height
    factor = F.least(F.lit(float(limits[0])) / F.nullif(width, F.lit(0)), F.lit(float(limits[1])) / F.nullif(height, F.lit(0)))
    scaled = F.coalesce((width > 0) & (height > 0) & (F.least(factor, F.lit(1.0)) < 1), F.lit(False))
    return tuple(F.when(scaled, _even(side * factor)).otherwise(side) for side in (width, height))


def enlarged(width: Column, height: Column, tier: str, sar: Column | None = None) -> tuple[Column, Column]:
    """The size to which a picture is enlarged to fill a tier from the shape that it is shown at; null where that gains too little."""
    limits = {n: (w, h) for n, w, h in RESOLUTIONS}.get(tier)
    if limits is None:
        return F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    num, den = (F.regexp_extract(F.coalesce(sar if sar is not None else F.lit(""), F.lit("")), r"^([0-9]+):([0-9]+)$", i).try_cast("double") for i in (1, 2))
    shown = width * F.coalesce(F.when((num > 0) & (den > 0), num / den), F.lit(1.0))
    factor = F.least(F.lit(float(limits[0])) / F.nullif(shown, F.lit(0.0)), F.lit(float(limits[1])) / F.nullif(height, F.lit(0)))
    good = (width > 0) & (height > 0) & (factor >= RESIZE_LEAST)
    return F.when(good, F.least(_even(shown * factor), F.lit(limits[0]))), F.when(good, F.least(_even(height * factor), F.lit(limits[1])))


def parsed_size(text: Column) -> tuple[Column, Column]:
    """Width and height of ``WxH`` text, null where it is none."""
    return tuple(F.regexp_extract(text, r"^\s*([0-9]+)[xX]([0-9]+)\s*$", i).try_cast("bigint") for i in (1, 2))


def to_whole(text: Column) -> Column:
    """A run of digits as a number, anything else null: unknown is not zero."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def to_chapters(text: Column) -> Column:
    """Chapter count as text: none at all is one chapter, leading zeros stay, what is no number (nothing stated included) is null."""
    return F.when(text.rlike(r"^0+$"), "1").when(text.rlike(r"^[0-9]+$"), text)


def to_seconds(text: Column) -> Column:
    """A decimal as text with three places, rounded as 80-bit floats are; anything else null."""
    from cataloom.functions.formats import three_decimals

    return F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), three_decimals(text))


def to_frame_rate(text: Column) -> Column:
    """``num/den`` in thousandths, rounded half up with whole numbers; zero and malformed rates are null."""
    num, den = (F.regexp_extract(text, r"^([0-9]+)/([0-9]+)$", i).try_cast("bigint") for i in (1, 2))
    thousandths = F.when((den > 0) & (num > 0), F.floor((num * 1000 + F.floor(den / 2)) / den))
    return F.nullif(thousandths, F.lit(0)) / 1000


def length_matches(source: Column, output: Column) -> Column:
    """Within a second or one per cent; an unknown source matches."""
    return F.when(source.isNull() | (source <= 0), True).otherwise(F.coalesce(F.abs(source - output) <= F.greatest(F.lit(1.0), source * 0.01), F.lit(False)))


def clock(seconds: Column) -> Column:
    """H:MM:SS."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
