"""Curves and choices: interpolation, BD-rate, least squares, cross-correlation, chapter sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def interpolate(points: Column, x: Column, clamp: bool = True) -> Column:
    """Piecewise linear value at x of an array of (x, y) sorted by x; beyond the ends flat, or along the end pieces."""
    n = F.size(points)
    after = F.least(F.greatest(F.size(F.filter(points, lambda p: p["x"] < x)), F.lit(1)), n - 1)
    a, b = F.get(points, after - 1), F.get(points, after)
    line = a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    if clamp:
        first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
        line = F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(line)
    return F.when(n == 1, F.get(points, F.lit(0))["y"]).otherwise(line)


def bd_rate(curves: DataFrame, by: str, one: str, other: str, steps: int = 200) -> DataFrame:
    """(rate): mean relative size of ``other`` to ``one`` over their shared range of scores, less 1.

    curves: (by, score, size); sizes are compared as logarithms at ``steps + 1`` scores.
    """
    points = curves.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("score").cast("double").alias("x"), F.log("size").alias("y")))).alias("p"))
    a, b = (points.where(F.col(by) == k).select(F.col("p").alias(n)) for k, n in ((one, "a"), (other, "b")))
    both = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")  # one row each
    low = F.greatest(F.array_min(F.transform("a", lambda p: p["x"])), F.array_min(F.transform("b", lambda p: p["x"])))
    high = F.least(F.array_max(F.transform("a", lambda p: p["x"])), F.array_max(F.transform("b", lambda p: p["x"])))
    at = both.withColumns({"low": low, "high": high}).where("low < high").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    at = at.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / steps)
    gap = at.select((interpolate(F.col("b"), F.col("x")) - interpolate(F.col("a"), F.col("x"))).alias("gap"))
    return gap.agg((F.exp(F.avg("gap")) - 1).alias("rate"))


def quality_curve(runs: DataFrame, by: list[str]) -> DataFrame:
    """Bits per pixel and mean score of each setting."""
    return runs.groupBy(*by).agg((F.sum("bits") / F.nullif(F.sum("pixels"), F.lit(0))).alias("bits_per_pixel"), F.avg("score").alias("score"))


def straight_line(rows: DataFrame, group: list[str], x: str, y: str, most: float = 40.0, least: int = 3) -> DataFrame:
    """(group, slope, intercept) of groups of enough points, none of which is further than ``most`` from the line."""
    fit = rows.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")).where(F.col("n") >= least)
    off = rows.join(fit, group).groupBy(*group).agg(F.max(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("off"))
    return fit.join(off.where(F.col("off") <= most), group).select(*group, "slope", "intercept")


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The upper of the middle elements, never a mean of two, by rank and not by gathering values."""
    w = Window.partitionBy(*group)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select(*group, F.col(value).alias("median"))


def grain_level(rows: DataFrame, group: list[str], grain: str) -> DataFrame:
    level = F.least(F.greatest(F.ceil(F.log2(F.median(grain))), F.lit(0)), F.lit(50))
    return rows.where(F.col(grain) > 0).groupBy(*group).agg(level.alias("level"))


#: Samples a second, samples of a step of the loudness curve, samples searched about a coarse place, and the scores under which neither
#: the curves nor the waveforms say anything.
RATE, HOP, REFINE = 8000, 80, 160
TRUSTED_CURVE, TRUSTED_WAVE = 0.5, 0.3


def _covered(signal: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of all stretches of the signal as long as the weights, by one product of spectra."""
    whole = len(signal) + len(weights) - 1
    spectrum = np.fft.rfft(signal, whole) * np.fft.rfft(weights[::-1], whole)
    return np.fft.irfft(spectrum, whole)[len(weights) - 1 : len(signal)]


def _fit(needle: np.ndarray, haystack: np.ndarray) -> tuple[int, float]:
    """Where the needle fits best and how well, 1 at most: a stretch's energy, itself a covered sum, is divided out, so loudness does not win."""
    if not 0 < len(needle) <= len(haystack):
        return 0, 0.0
    powers = _covered(haystack * haystack, np.ones(len(needle))) * float(needle @ needle)
    silent = powers <= 1e-9 * max(float(powers.max()), 1e-9)
    fits = np.where(silent, 0.0, _covered(haystack, needle) / np.sqrt(np.where(silent, 1.0, powers)))
    return int(fits.argmax()), float(fits.max())


def _loudness(wave: np.ndarray, hop: int) -> np.ndarray:
    """How loud each ``hop`` samples are, as logarithms about their mean."""
    n = len(wave) // hop
    level = np.log(np.sqrt((wave[: n * hop].reshape(n, hop) ** 2).mean(axis=1)) + 1e-4) if n else np.zeros(0)
    return level - level.mean() if n else level


def _arrays(a: pd.Series, b: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    for x, y in zip(a, b, strict=True):
        yield None if x is None or y is None else (np.asarray(x, float), np.asarray(y, float))


@F.pandas_udf(StructType([StructField("lag", LongType()), StructField("score", DoubleType())]))
def best_lag(needle: pd.Series, haystack: pd.Series) -> pd.DataFrame:
    """Where in the haystack the needle fits best, in samples, and the normalised correlation there; 0 and 0 where it is longer; nulls for null."""
    found = [pair and _fit(*pair) for pair in _arrays(needle, haystack)]
    return pd.DataFrame({"lag": pd.array([f and f[0] for f in found], "Int64"), "score": [f and f[1] for f in found]})


def lag_seconds(needle: Column, haystack: Column, rate: int = RATE, hop: int = HOP, refine: int = REFINE) -> Column:
    """Where the needle begins in the haystack, in seconds: found on the loudness of both, then placed to the sample where the waveforms agree too.

    Null where even the loudness does not fit well enough to say, and for null.
    """

    @F.pandas_udf(DoubleType())
    def seconds(a: pd.Series, b: pd.Series) -> pd.Series:
        def place(x: np.ndarray, y: np.ndarray) -> float | None:
            step, score = _fit(_loudness(x, hop), _loudness(y, hop))
            if score < TRUSTED_CURVE:
                return None
            near = max(0, step * hop - refine)
            fine, fine_score = _fit(x, y[near : step * hop + refine + len(x)])
            return (near + fine) / rate if fine_score >= TRUSTED_WAVE else step * hop / rate

        return pd.Series([pair and place(*pair) for pair in _arrays(a, b)], dtype=float)

    return seconds(needle, haystack)


def same_chapters(a: Column, b: Column, within: float = 1.0) -> Column:
    """Equally many starts, each pair within ``within`` seconds."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= within), lambda ok: ok)


def chosen_set(sets: DataFrame, key: str, seconds: Column) -> DataFrame:
    """Per key the set to use: named and English ones first, then most confirmed, then nearest in length; ids break ties."""
    order = F.struct((~F.col("named")).alias("a"), (F.coalesce(F.col("language"), F.lit("")) != "eng").alias("b"), (-F.col("confirmations")).alias("c"), F.abs(F.col("seconds") - seconds).alias("d"), F.col("id").alias("e"))
    return sets.where(F.abs(F.col("seconds") - seconds) <= 2).groupBy(key).agg(F.min_by("id", order).alias("id"))
