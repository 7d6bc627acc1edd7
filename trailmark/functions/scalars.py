"""Scalar functions on columns, and settings derived from others."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x moved into [low, high]; a missing value stays missing."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def display_map(x: Column) -> Column:
    """Stretches small magnitudes by half, moves larger ones out by 5, and keeps the sign."""
    size = F.abs(x)
    return F.signum(x) * F.when(size < 10, 1.5 * size).otherwise(size + 5)


def index_of(frame: Column, fi: Column, ff: Column) -> Column:
    """The position (1..) of a frame in a tracklet's life, NULL outside it."""
    return F.when((frame >= fi) & (frame <= ff), frame - fi + 1)


def frame_of(index: Column, fi: Column, ff: Column) -> Column:
    """The frame at a position (1..) of a tracklet's life, NULL outside it."""
    return F.when((index >= 1) & (index <= ff - fi + 1), fi + index - 1)


def angle_difference(a: Column, b: Column) -> Column:
    """a - b taken the short way round, in [-pi, pi)."""
    from trailmark.model import wrap

    return wrap(a - b)


def likelihood(own: Column, other: Column, sd: float, threshold: float) -> Column:
    """The share of the normal density at ``own`` in that of both distances, cut to [threshold, 1 - threshold] and stretched to [0, 1]."""
    density = lambda d: F.exp(-d * d / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))
    p = F.try_divide(density(own), density(own) + density(other))
    return (clip(p, threshold, 1 - threshold) - threshold) / (1 - 2 * threshold)


def palette_distance(r: Column, g: Column, b: Column, palette: list[tuple[float, float, float]]) -> Column:
    """Distance of a colour from the nearest of a palette."""
    each = [F.sqrt((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)) for x, y, z in palette]
    return F.least(*each) if len(each) > 1 else each[0]


def derived_settings(p: dict[str, float]) -> dict[str, float]:
    """Settings that follow from others: mean area, side of the square around an animal in pixels, linking cutoffs."""
    scale, most, least = p["geometry_rscale"], p["thrsh_meanareamax"], p["thrsh_meanareamin"]
    half = math.sqrt(most) / scale
    out = {"thrsh_meanarea": (most + least) / 2, "sqsz": 2 * math.floor(half + 0.5)}
    if "linking_flow_cutoff_coeff" in p:
        out["linking_flow_cutoff"] = p["linking_flow_cutoff_coeff"] * least / scale**2
    if "linking_ofconnectmin_0" in p:
        sizes = out["thrsh_meanarea"] / p["thrsh_meanareamin_0"]
        out["linking_ofconnectmin"] = p["linking_ofconnectmin_0"] * p["linking_scale_factor"] * sizes * (p["geometry_scale0"] / scale) ** 2
    return out


def row_normal(p: Column) -> Column:
    """An array divided by its sum."""
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.transform(p, lambda v: F.try_divide(v, total))


def square_box(x0: Column, y0: Column, w: Column, h: Column, margin: int = 4) -> tuple[Column, Column, Column]:
    """(x, y, size) of the square about a bounding box, the longer side plus a margin."""
    size = F.greatest(w, h) + margin
    return F.round(x0 + w / 2 - size / 2), F.round(y0 + h / 2 - size / 2), size
