"""Boxes are structs (x1, y1, x2, y2) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_PIXELS, COLLISION_IOU = 50.0, 0.3


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def distance(p: Column, q: Column) -> Column:
    """Of two points; null if either is missing."""
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def iou(a: Column, b: Column) -> Column:
    """0 without overlap or area; null if a box is missing."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    united = area(a) + area(b) - w * h
    return F.when(a.isNotNull() & b.isNotNull(), F.when((w <= 0) | (h <= 0) | (united <= 0), 0.0).otherwise(F.try_divide(w * h, united)))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x1"] <= inner["x1"]) & (outer["y1"] <= inner["y1"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def polygon_box(points: Column) -> Column:
    """The box around an array of points (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def relations(a: Column, b: Column, near: float = NEAR_PIXELS) -> Column:
    """Spatial relations of a to b: near, one direction (the longer axis; vertical on the diagonal), contains."""
    p, q = center(a), center(b)
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    side = F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "left_of").otherwise("right_of")).otherwise(F.when(dy > 0, "above").otherwise("below"))
    return F.array_compact(F.array(F.when(distance(p, q) < near, "near"), side, F.when(contains(a, b), "contains")))


def collides(a: Column, b: Column, least: float = COLLISION_IOU) -> Column:
    return iou(a, b) >= least


def expanded(b: Column, w: Column, h: Column, share: float = 0.1) -> Column:
    """The box grown by a share of its size on each side, within a frame of w by h."""
    dx, dy = width(b) * share, height(b) * share
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x1"] - dx), F.greatest(zero, b["y1"] - dy), F.least(w.cast("double"), b["x2"] + dx), F.least(h.cast("double"), b["y2"] + dy))


def absolute(b: Column, w: Column, h: Column) -> Column:
    """A box of shares of the frame in whole pixels."""
    return F.struct(*[F.floor(b[n] * s).alias(n) for n, s in (("x1", w), ("y1", h), ("x2", w), ("y2", h))])


def mask_iou(a: Column, b: Column) -> Column:
    """Of masks (h, w, bits: array of booleans): 0 where shapes differ or nothing is set."""
    both = F.size(F.filter(F.zip_with(a["bits"], b["bits"], lambda x, y: x & y), lambda x: x))
    either = F.size(F.filter(F.zip_with(a["bits"], b["bits"], lambda x, y: x | y), lambda x: x))
    return F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), F.coalesce(F.try_divide(both, either), F.lit(0.0))).otherwise(0.0)


def pixel_budget(detail: Column, least: int = 256 * 32 * 32, most: int = 1024 * 32 * 32) -> Column:
    """(min_pixels, max_pixels) of a level of detail: low, high, or the given bounds."""
    bounds = lambda lo, hi: F.struct(F.lit(lo).alias("min_pixels"), F.lit(hi).alias("max_pixels"))
    return F.when(detail == "low", bounds(128 * 1024, 256 * 1024)).when(detail == "high", bounds(512 * 1024, 1024 * 1024)).otherwise(bounds(least, most))


def patch_size(w: Column, h: Column, least: int = 224, most: int = 768, patch: int = 14) -> Column:
    """Width and height scaled to fit ``most``, not below ``least``, cut to whole patches."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    cut = lambda x: (F.floor(F.greatest(F.lit(float(least)), x * scale) / patch) * patch).cast("int")
    return F.struct(cut(w).alias("w"), cut(h).alias("h"))
