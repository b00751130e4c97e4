"""Column functions on boxes struct<x, y, width, height>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NEAR_PX, OVERLAP_SHARE


def half_up(c: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(c + 0.5)


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def overlap(a: Column, b: Column) -> Column:
    """Whether the boxes share a quarter of the smaller one, or their centres are within 20 px each way."""
    across = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
    near = [F.abs(a[p] + a[s] / 2 - b[p] - b[s] / 2) <= NEAR_PX for p, s in (("x", "width"), ("y", "height"))]
    return ((smaller > 0) & (across * down >= OVERLAP_SHARE * smaller)) | (near[0] & near[1])


def viewport_to_bitmap(b: Column, vw: Column, vh: Column, bw: Column, bh: Column) -> Column:
    sx, sy = bw / vw, bh / vh
    x, y = F.greatest(F.lit(0), half_up(b["x"] * sx)), F.greatest(F.lit(0), half_up(b["y"] * sy))
    return box(x, y, F.least(bw - x, F.greatest(F.lit(0), half_up(b["width"] * sx))), F.least(bh - y, F.greatest(F.lit(0), half_up(b["height"] * sy))))


def page_to_bitmap(b: Column, scroll_x: Column, scroll_y: Column, vw: Column, vh: Column, bw: Column, bh: Column) -> Column:
    return viewport_to_bitmap(box(b["x"] - scroll_x, b["y"] - scroll_y, b["width"], b["height"]), vw, vh, bw, bh)


def in_viewport(b: Column, scroll_x: Column, scroll_y: Column, vw: Column, vh: Column) -> Column:
    x, y = b["x"] - scroll_x, b["y"] - scroll_y
    return (x + b["width"] > 0) & (x < vw) & (y + b["height"] > 0) & (y < vh)


def bitmap_to_viewport(b: Column, vw: Column, vh: Column, bw: Column, bh: Column) -> Column:
    sx, sy = vw / bw, vh / bh
    return box(half_up(b["x"] * sx), half_up(b["y"] * sy), half_up(b["width"] * sx), half_up(b["height"] * sy))


def bounding_box(points: Column) -> Column:
    """Enclosing box of array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def _scaled(b: Column, sx: Column, sy: Column, pad_x: Column, pad_y: Column, bw: Column, bh: Column) -> Column:
    x, y = F.greatest(F.lit(0), half_up((b["x"] - pad_x) / sx)), F.greatest(F.lit(0), half_up((b["y"] - pad_y) / sy))
    return box(x, y, F.least(bw - x, F.greatest(F.lit(0), half_up(b["width"] / sx))), F.least(bh - y, F.greatest(F.lit(0), half_up(b["height"] / sy))))


def model_to_bitmap(b: Column, bw: Column, bh: Column, mw: Column, mh: Column) -> Column:
    """A model's box in the bitmap: shares of it if nothing exceeds 1, else out of the letterbox, or scaled where there is none."""
    sides = [b[n] for n in ("x", "y", "width", "height")]
    shares = F.greatest(*sides) <= 1
    share = box(
        F.greatest(F.lit(0), half_up(b["x"] * bw)), F.greatest(F.lit(0), half_up(b["y"] * bh)), F.least(bw, half_up(b["width"] * bw)), F.least(bh, half_up(b["height"] * bh))
    )
    scale = F.least(mw / bw, mh / bh)
    pad_x, pad_y = F.greatest(F.lit(0), (mw - bw * scale) / 2), F.greatest(F.lit(0), (mh - bh * scale) / 2)
    return F.when(shares & ((b["width"] > 0) | (b["height"] > 0)), share).otherwise(_scaled(b, scale, scale, pad_x, pad_y, bw, bh))


def label_box(b: Column, width: Column, height: Column) -> Column:
    """Pixels to the centre and size as shares of the image, clamped; null if either side is nothing."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    centre = box(clamp((b["x"] + b["width"] / 2) / width), clamp((b["y"] + b["height"] / 2) / height), clamp(b["width"] / width), clamp(b["height"] / height))
    return F.when((b["width"] > 0) & (b["height"] > 0), centre)
