"""Census columns from the JSON that a media probe prints for a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.files import container_name, lower_extension_of, range_name

_STREAM = (
    "struct<index:int,codec_type:string,codec_name:string,width:int,height:int,channels:int,bit_rate:string,avg_frame_rate:string,r_frame_rate:string,"
    "duration:string,color_transfer:string,disposition:struct<attached_pic:int>,tags:map<string,string>,side_data_list:array<struct<side_data_type:string>>>"
)
PROBE = f"struct<streams:array<{_STREAM}>,format:struct<format_name:string,duration:string,size:string,bit_rate:string>,chapters:array<struct<id:bigint>>>"
#: What an audio stream of unknown rate is taken to need per channel, and the share of what is left that is the video's own.
AUDIO_PER_CHANNEL, OWN_SHARE = 64_000, 0.98


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _stated(stream: Column) -> Column:
    """A stream's own rate: the field, or a tag whose name begins with BPS."""
    tag = F.get(F.map_values(F.map_filter(F.coalesce(stream["tags"], F.create_map().cast("map<string,string>")), lambda k, _: k.rlike("^BPS($|-)"))), F.lit(0))
    return F.coalesce(_number(stream["bit_rate"]), _number(tag))


def frame_rate(text: Column) -> Column:
    """num/den as a number; null where either is 0 or missing."""
    num, den = (_number(F.regexp_extract(text, r"^([0-9.]+)/([0-9.]+)$", i)) for i in (1, 2))
    return F.when((num > 0) & (den > 0), num / den)


def probed(rows: DataFrame, path: str, document: str) -> DataFrame:
    """Adds the columns of a census row to rows of (path, probe document); a document that is none gives nulls.

    The video rate is the stream's own where it states one, else all of the file's without its audio streams: an estimate, and said so.
    """
    probe = rows.withColumn("__p", F.from_json(document, PROBE))
    streams = F.coalesce(F.col("__p.streams"), F.array().cast(f"array<{_STREAM}>"))
    pictures = F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
    sounds = F.filter(streams, lambda s: s["codec_type"] == "audio")
    probe = probe.withColumns({"__v": F.get(pictures, F.lit(0)), "__a": sounds})
    video, form = F.col("__v"), F.col("__p.format")
    audio_rate = F.aggregate("__a", F.lit(0.0), lambda total, s: total + F.coalesce(_stated(s), F.coalesce(s["channels"], F.lit(2)) * F.lit(float(AUDIO_PER_CHANNEL))))
    seconds = _number(form["duration"])
    total = F.coalesce(_number(form["bit_rate"]), F.when(seconds > 0, _number(form["size"]) * 8 / seconds))
    rate = F.coalesce(_stated(video), (total - audio_rate) * OWN_SHARE)
    vision = F.exists(F.coalesce(video["side_data_list"], F.array().cast("array<struct<side_data_type:string>>")), lambda d: d["side_data_type"].contains("DOVI"))
    out = {
        "container": container_name(form["format_name"], lower_extension_of(F.col(path))),
        "durationSeconds": seconds,
        "sizeBytes": form["size"].try_cast("bigint"),
        "videoCodec": video["codec_name"],
        "width": video["width"],
        "height": video["height"],
        "frameRate": F.coalesce(frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])),
        "dynamicRange": F.when(video.isNotNull(), range_name(video["color_transfer"], vision)),
        "videoKbit": F.when(rate > 0, F.floor(rate / 1000)),
        "videoRateOrigin": F.when(_stated(video).isNotNull(), "stated").when(total.isNotNull(), "estimated").otherwise(""),
        "audioTracks": F.size("__a"),
        "chapters": F.size(F.coalesce(F.col("__p.chapters"), F.array().cast("array<struct<id:bigint>>"))),
    }
    return probe.withColumns(out).drop("__p", "__v", "__a")
