"""Box algebra as Column expressions; every function stays inside code generation."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | int | Column


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def lit(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def cols(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + name) for name in ("x1", "y1", "x2", "y2")))


def field(get: Callable[[str], Column], prefix: str = "") -> Box:
    """The box read through an accessor, such as a lambda element of an array."""
    return Box(*(get(prefix + name) for name in ("x1", "y1", "x2", "y2")))


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y2 - b.y1)


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    dx = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    dy = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlap_min(a: Box, b: Box) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2.0


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2.0


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def center_distance(a: Box, b: Box, w: Number, h: Number) -> Column:
    """Distance of the centres with x in frame widths and y in frame heights."""
    dx = (center_x(a) - center_x(b)) / lit(w)
    dy = (center_y(a) - center_y(b)) / lit(h)
    return F.sqrt(dx * dx + dy * dy)


def contains_point(b: Box, x: Column, y: Column) -> Column:
    return (b.x1 <= x) & (x <= b.x2) & (b.y1 <= y) & (y <= b.y2)


def blend(old: Box, new: Box, alpha: Number) -> Box:
    keep = F.lit(1.0) - lit(alpha)
    return Box(*(keep * o + lit(alpha) * n for o, n in zip(old, new)))


def clamp(b: Box, w: Number, h: Number) -> Box:
    def within(v: Column, top: Number) -> Column:
        return F.greatest(F.lit(0.0), F.least(lit(top).cast("double"), v))

    return Box(within(b.x1, w), within(b.y1, h), within(b.x2, w), within(b.y2, h))


def expand(b: Box, w: Number, h: Number, pad_x: Number, pad_y: Number) -> Box:
    px, py = lit(pad_x), lit(pad_y)
    return clamp(Box(b.x1 - px, b.y1 - py, b.x2 + px, b.y2 + py), w, h)


def scale_center(b: Box, w: Number, h: Number, sx: Number, sy: Number) -> Box:
    """Scale about the centre; each half side is at least one pixel."""
    half_w = F.greatest(F.lit(1.0), (b.x2 - b.x1) * lit(sx) / 2.0)
    half_h = F.greatest(F.lit(1.0), (b.y2 - b.y1) * lit(sy) / 2.0)
    cx, cy = center_x(b), center_y(b)
    return clamp(Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h), w, h)


def scale_min_size(b: Box, w: Number, h: Number, sx: Number, sy: Number, least_px: float = 6.0) -> Box:
    """Scale about the centre after raising each side to `least_px`."""
    half_w = F.greatest(F.lit(least_px), b.x2 - b.x1) * lit(sx) / 2.0
    half_h = F.greatest(F.lit(least_px), b.y2 - b.y1) * lit(sy) / 2.0
    cx, cy = center_x(b), center_y(b)
    return clamp(Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h), w, h)


def pad_to_aspect(b: Box, aspect: float = 3.0) -> Box:
    """Widen evenly to the left and right until width is `aspect` times height."""
    extra = F.greatest(F.lit(0.0), height(b) * aspect - width(b)) / 2.0
    return Box(b.x1 - extra, b.y1, b.x2 + extra, b.y2)


def sub_window(b: Box, left: float, top: float, right: float, bottom: float) -> Box:
    w = F.greatest(F.lit(1.0), b.x2 - b.x1)
    h = F.greatest(F.lit(1.0), b.y2 - b.y1)
    return Box(b.x1 + w * left, b.y1 + h * top, b.x1 + w * right, b.y1 + h * bottom)


def struct(b: Box, *more: Column) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))), *more)


def named(b: Box, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))]


def position_score(b: Box, w: Number, h: Number) -> Column:
    cx, cy = center_x(b), center_y(b)
    left = F.when(cx < lit(w) * 0.18, 0.35).otherwise(0.0)
    low = F.when(cy > lit(h) * 0.62, 0.30).otherwise(0.0)
    corner = F.when((b.x1 < lit(w) * 0.08) & (cy > lit(h) * 0.70), 0.25).otherwise(0.0)
    return F.least(left + low + corner, F.lit(0.8))


def position_bin(b: Box, w: Number, h: Number) -> Column:
    cx, cy = center_x(b) / lit(w), center_y(b) / lit(h)
    row = F.when(cy < 0.4, "top").when(cy > 0.6, "bottom").otherwise("mid")
    column = F.when(cx < 0.4, "left").when(cx > 0.6, "right").otherwise("center")
    return F.concat_ws("-", row, column)


def normalized_geometry(b: Box, w: Number, h: Number) -> dict[str, Column]:
    fw = F.greatest(F.lit(1), lit(w))
    fh = F.greatest(F.lit(1), lit(h))
    frame = F.greatest(F.lit(1), lit(w) * lit(h))
    return {
        "bbox_x1_norm": b.x1 / fw,
        "bbox_y1_norm": b.y1 / fh,
        "bbox_x2_norm": b.x2 / fw,
        "bbox_y2_norm": b.y2 / fh,
        "bbox_cx_norm": center_x(b) / fw,
        "bbox_cy_norm": center_y(b) / fh,
        "bbox_w_norm": width(b) / fw,
        "bbox_h_norm": height(b) / fh,
        "bbox_area_norm": area(b) / frame,
        "bbox_area_ratio": area(b) / frame,
        "bbox_aspect": width(b) / F.greatest(F.lit(1.0), height(b)),
    }


def is_lower_left(b: Box, w: Number, h: Number) -> Column:
    return (center_x(b) < lit(w) * 0.22) & (center_y(b) > lit(h) * 0.62)
