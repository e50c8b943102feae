"""Requirement models: what a stream or picture would need to be adequate, and the verdict on what it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.dimensions import UNKNOWN, codec_era, codec_family, folded, image_kind, lookup

# Anchors and tuning that results depend on.
GENEROUS_FACTOR = 2
VIDEO_ANCHOR_KBIT, VIDEO_ANCHOR_PIXELS = 5000, 2073600
VIDEO_TUNING = {
    "mpeg2": (1.00, 0.80), "intra": (1.00, 0.80), "mpeg4": (1.00, 0.80), "vc1": (1.25, 0.85), "vp8": (1.30, 0.86),
    "h264": (1.00, 0.80), "vp9": (0.82, 0.78), "hevc": (0.78, 0.77), "av1": (0.60, 0.70), "vvc": (0.50, 0.66),
}
ERA_PENALTY = {"mpeg2Era": 2.00, "mpeg4Era": 1.50, "modern": 1.00}
FRAME_RATE_REFERENCE, FRAME_RATE_EXPONENT, FRAME_RATE_MOST = 30, 0.585, 2.0
GRAIN_KNEE, GRAIN_FULL, GRAIN_SURCHARGE = 20, 40, 0.5
AUDIO_ANCHOR = {"music": (100, 120, 150, 185, 220, 250, 285, 320), "speech": (55, 65, 85, 110, 130, 150, 175, 200)}
#: family, whether it is lossless, cost relative to the anchor, names
AUDIO_CODECS = (
    ("opus", False, 1.00, ("opus", "libopus")),
    ("xheaac", False, 1.00, ("xhe-aac", "usac")),
    ("heaac", False, 1.10, ("he-aac", "heaacv2", "he-aacv2", "aac_he")),
    ("vorbis", False, 1.20, ("vorbis", "libvorbis")),
    ("aac", False, 1.30, ("aac", "aac_latm", "mp4a")),
    ("eac3", False, 1.35, ("eac3", "ec-3", "dd+")),
    ("wma", False, 1.55, ("wmav1", "wmav2", "wmapro", "wmalossless")),
    ("mp3", False, 1.60, ("mp3", "mp2", "mp1", "mp3float", "mp3adu")),
    ("ac3", False, 1.70, ("ac3", "ac-3", "dnet")),
    ("dts", False, 3.00, ("dts", "dca")),
    ("pcm", True, 1.00, ("pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be", "pcm_s32le", "pcm_f32le", "wav")),
    ("flac", True, 1.00, ("flac",)),
    ("alac", True, 1.00, ("alac",)),
    ("wavpack", True, 1.00, ("wavpack", "wv")),
    ("ape", True, 1.00, ("ape", "monkeys audio")),
    ("truehd", True, 1.00, ("truehd", "mlp")),
)
SYNTHESIS_GAIN, HARDWARE_PENALTY = 0.25, 1.15
IMAGE_BPP, IMAGE_REFERENCE_PIXELS = 1.0, 1_000_000
IMAGE_COLOUR, IMAGE_DETAIL = {"grey": 0.80}, {"art": 0.45, "line": 0.15}
SPEECH_SECONDS = 1200


def verdict(have: Column, need: Column, factor: float = GENEROUS_FACTOR) -> Column:
    """starved, adequate or generous; unknown where either figure is missing or not positive."""
    return F.when(have.isNull() | need.isNull() | (need <= 0) | (have <= 0), UNKNOWN).when(have < need, "starved").when(have >= need * factor, "generous").otherwise("adequate")


def _never_starved(name: Column, lossless: Column) -> Column:
    return F.when(lossless & (name == "starved"), "adequate").otherwise(name)


def video_requirement(codec: Column, width: Column, height: Column, tier_pixels: Column, fps: Column, grain: Column, synthesised: Column | None = None, hardware: Column | None = None) -> Column:
    """kbit/s: the anchor scaled by codec, tier, shape, grain, frame rate, era and encoder; null without a frame size.

    Grain that is ``synthesised`` is not coded: the codec keeps its advantage and what is left is easier to code.
    """
    family = codec_family(codec)
    factor = lookup(family, {k: v[0] for k, v in VIDEO_TUNING.items()}, 1.0)
    power = lookup(family, {k: v[1] for k, v in VIDEO_TUNING.items()}, 0.80)
    noise = F.least(F.greatest((F.coalesce(grain, F.lit(0.0)) - GRAIN_KNEE) / (GRAIN_FULL - GRAIN_KNEE), F.lit(0.0)), F.lit(1.0))
    rate = F.when(fps > FRAME_RATE_REFERENCE, F.least(F.pow(fps / FRAME_RATE_REFERENCE, F.lit(FRAME_RATE_EXPONENT)), F.lit(FRAME_RATE_MOST))).otherwise(1.0)
    era = lookup(codec_era(codec), ERA_PENALTY, 1.0)
    synthetic, slow = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (synthesised, hardware))
    coded = F.when(synthetic, 0.0).otherwise(noise)
    need = VIDEO_ANCHOR_KBIT * (factor + (1 - factor) * coded) * F.pow(tier_pixels / VIDEO_ANCHOR_PIXELS, power + (1 - power) * coded)
    grained = F.when(synthetic, 1 - SYNTHESIS_GAIN * noise).otherwise(1 + GRAIN_SURCHARGE * noise)
    need = need * (width * height / tier_pixels) * grained * rate * F.when(slow, HARDWARE_PENALTY).otherwise(1.0) * era
    return F.when((tier_pixels > 0) & (width > 0) & (height > 0), F.rint(need))


def _audio_column(codec: Column, pick: int, otherwise) -> Column:
    names = {}
    for row in AUDIO_CODECS:
        for name in (row[0], *row[3]):
            names.setdefault(name, row[pick])
    return lookup(folded(codec), names, otherwise)


def audio_family(codec: Column) -> Column:
    return _audio_column(codec, 0, UNKNOWN)


def audio_requirement(codec: Column, channels: Column, content: Column) -> Column:
    """kbit/s by channel count (1 to 8) and kind of content, times the codec's cost."""
    columns = {kind: F.element_at(F.array(*[F.lit(float(x)) for x in row]), channels.cast("int")) for kind, row in AUDIO_ANCHOR.items()}
    anchor = F.when(content == "speech", columns["speech"]).otherwise(columns["music"])
    return F.when(channels.between(1, 8), F.rint(anchor * _audio_column(codec, 2, 1.0)))


def audio_adequacy(codec: Column, channels: Column, bits_per_second: Column, content: Column) -> Column:
    rate = F.when(bits_per_second > 0, F.rint(bits_per_second / 1000))
    return _never_starved(verdict(rate, audio_requirement(codec, channels, content)), _audio_column(codec, 1, False))


def audio_content(suffix: Column, seconds: Column) -> Column:
    return F.when((suffix == "m4b") | (seconds > SPEECH_SECONDS), "speech").otherwise("music")


def image_requirement(width: Column, height: Column, power: Column, colour: Column, detail: Column) -> Column:
    """Bytes: bits per pixel at this size, times pixels."""
    pixels = (width * height).cast("double")
    bpp = IMAGE_BPP * lookup(colour, IMAGE_COLOUR, 1.0) * lookup(detail, IMAGE_DETAIL, 1.0) * F.pow(pixels / IMAGE_REFERENCE_PIXELS, power - 1)
    return F.when((width > 0) & (height > 0), F.rint(bpp * pixels / 8))


def image_adequacy(codec: Column, size_bytes: Column, need: Column) -> Column:
    kind = image_kind(codec)
    return F.when(kind == "vector", UNKNOWN).otherwise(_never_starved(verdict(size_bytes, need), kind.isin("lossless", "palette")))
