"""Timecodes, frames and sampling times: Column to Column."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright import rules


def to_seconds(code: Column, tolerant: bool = False) -> Column:
    """Seconds of ``HH:MM:SS.mmm``; a code that is none gives null, or 0.0 if ``tolerant``."""
    p = F.split(code, ":")
    part = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind).cast("double")
    value = F.when(F.size(p) == 3, part(0, "int") * 3600 + part(1, "int") * 60 + part(2, "double"))
    return F.coalesce(value, F.lit(0.0)) if tolerant else value


def from_seconds(x: Column) -> Column:
    """``HH:MM:SS.mmm``; seconds that round up to 60 are not carried."""
    hours, rest = F.floor(x / 3600), x % 3600
    return F.format_string("%02d:%02d:%06.3f", hours, F.floor(rest / 60), rest % 60)


def frame_of(seconds: Column, fps: Column) -> Column:
    """The whole frame that a time falls in."""
    return (seconds * fps).cast("long")


def nearest_frame(seconds: Column, fps: Column) -> Column:
    return F.rint(seconds * fps).cast("long")


def sample_times(start: Column, end: Column, duration: Column, points: int = 7) -> Column:
    """Array of times to look at: the middle of a very short scene, else equidistant with both ends."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: start + duration * (i / F.lit(float(points - 1))))
    return F.when(duration < 0.5, F.array((start + end) / 2)).otherwise(spread)


def corner_frames(start: Column, end: Column, fps: Column, total: Column, margin: float = 0.01) -> Column:
    """Array of struct(which, frame) just behind a scene's start, at its middle and just before its end, within the film."""
    inside = lambda t: F.greatest(F.lit(0), F.least(F.greatest(total - 1, F.lit(0)), nearest_frame(t, fps)))
    length = F.greatest(F.lit(0.0), end - start)
    first, last = F.least(F.greatest(start + margin, F.lit(0.0)), end), F.greatest(F.least(end - margin, end), start)
    times = (("start", first), ("mid", F.least(F.greatest(start + length / 2, start), end)), ("end", last))
    return F.array(*(F.struct(F.lit(k).alias("which"), inside(t).alias("frame")) for k, t in times))


def middle_frame(start: Column, end: Column, fps: Column) -> Column:
    """The frame at a scene's middle; times that are unknown count as 0, a rate as 24."""
    mid = (F.coalesce(start, F.lit(0.0)) + F.coalesce(end, F.lit(0.0))) / 2
    return F.greatest(F.lit(0), frame_of(mid, F.coalesce(F.when(fps > 0, fps), F.lit(24.0))))


def fitted(width: Column, height: Column, most: int = 720) -> Column:
    """struct(width, height) of a frame shrunk so that neither side exceeds ``most``."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def duration_flexibility(duration: Column) -> Column:
    d = F.coalesce(duration.try_cast("double"), F.lit(0.0))
    return F.when(d < 1, "exact").when(d < 5, "strict").when(d < 15, "loose").otherwise("any")


def downscale(width: Column) -> Column:
    """Factor by which frames are shrunk for detection; 2 where the width is unknown."""
    return F.when(width.isNull(), 2).when(width >= 3840, 3).when(width >= 1920, 2).otherwise(1)


def least_scene_seconds(fps: Column) -> Column:
    """Twelve frames; half a second where the rate is unknown."""
    return F.coalesce(F.try_divide(F.lit(12.0), fps), F.lit(0.5))


@F.pandas_udf(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))
def _fraction(x: pd.Series) -> pd.DataFrame:
    """Best rational with a denominator of 100000 at most; Spark has no such function."""
    parts = [Fraction(v).limit_denominator(100000) if v == v else Fraction(0) for v in x]
    return pd.DataFrame({"num": [p.numerator for p in parts], "den": [p.denominator for p in parts]})


def frame_rate(value: Column, fallback: float = 30.0, exact_only: bool = False) -> Column:
    """struct(value, num, den): the broadcast rate within 0.01, or a whole rate within 0.001, or a rational.

    A rate that is no number, or not positive, is ``fallback``.  With ``exact_only`` other rates have null num and den
    (and no Python runs).
    """
    v = value.try_cast("double")
    v = F.when(v > 0, v).otherwise(F.lit(fallback))
    out = None
    struct = lambda x, n, d: F.struct(x.cast("double").alias("value"), n.cast("long").alias("num"), d.cast("long").alias("den"))
    for about, num, den in rules.BROADCAST_RATES:
        hit, then = F.abs(v - about) < 0.01, struct(F.lit(num / den), F.lit(num), F.lit(den))
        out = F.when(hit, then) if out is None else out.when(hit, then)
    out = out.when(F.abs(v - F.rint(v)) < 0.001, struct(F.rint(v), F.rint(v), F.lit(1)))
    rest = F.struct(F.lit(None).cast("long").alias("num"), F.lit(None).cast("long").alias("den")) if exact_only else _fraction(v)
    return out.otherwise(struct(v, rest["num"], rest["den"]))
