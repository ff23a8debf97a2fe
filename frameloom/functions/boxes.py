"""Geometry of relative boxes: arrays of struct<x,y,w,h> in units of the frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import clamp, col, let

EPS = 1e-6


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def no_boxes() -> Column:
    return F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")


def total(boxes: Column, measure: Callable[[Column], Column]) -> Column:
    return F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + measure(b))


def area(b: Column) -> Column:
    return clamp(b["w"], 0.0, 1.0) * clamp(b["h"], 0.0, 1.0)


def clip_boxes(boxes: Column | str) -> Column:
    """Drop boxes without extent, move the rest into the unit square, drop the emptied."""

    def inside(b: Column) -> Column:
        x, y = clamp(b["x"], 0.0, 1.0), clamp(b["y"], 0.0, 1.0)
        return box(x, y, F.least(b["w"], 1.0 - x), F.least(b["h"], 1.0 - y))

    solid = F.filter(col(boxes), lambda b: (b["w"] > 0) & (b["h"] > 0))
    return F.filter(F.transform(solid, inside), lambda b: (b["w"] > 0) & (b["h"] > 0))


def pixel_boxes(boxes: Column | str, width: Column, height: Column, min_side: int = 24) -> Column:
    """Pixel rectangles (x0, y0, x1, y1) clamped to the image; small ones are dropped."""

    def pixels(b: Column) -> Column:
        low = lambda v: F.greatest(F.lit(0.0), F.rint(v)).cast("long")
        return F.struct(
            low(b["x"] * width).alias("x0"),
            low(b["y"] * height).alias("y0"),
            F.least(width, F.rint((b["x"] + b["w"]) * width)).cast("long").alias("x1"),
            F.least(height, F.rint((b["y"] + b["h"]) * height)).cast("long").alias("y1"),
        )

    return F.filter(
        F.transform(col(boxes), pixels),
        lambda p: (p["x1"] - p["x0"] >= min_side) & (p["y1"] - p["y0"] >= min_side),
    )


# How far a face box grows into a head-and-shoulders box.
PAD_UP, PAD_DOWN, PAD_SIDE = 0.45, 1.4, 0.25


def pad_boxes(boxes: Column | str, up: float = PAD_UP, down: float = PAD_DOWN, side: float = PAD_SIDE) -> Column:
    def grown(b: Column) -> Column:
        left = F.greatest(F.lit(0.0), b["x"] - b["w"] * side)
        top = F.greatest(F.lit(0.0), b["y"] - b["h"] * up)
        right = F.least(F.lit(1.0), b["x"] + b["w"] * (1.0 + side))
        bottom = F.least(F.lit(1.0), b["y"] + b["h"] * (1.0 + down))
        return box(left, top, right - left, bottom - top)

    return F.transform(col(boxes), grown)


def _window_start(size: Column, low: Column, high: Column, pull: str | None) -> Column:
    """Where a crop window of ``size`` starts so that [low, high] stays in it if it can."""
    slack = F.greatest(F.lit(0.0), 1.0 - size)
    centred = (1.0 - size) / 2.0
    a = F.greatest(F.lit(0.0), high - size)
    b = F.least(slack, low)
    first, last = F.least(a, b), F.greatest(a, b)
    fitting = {"low": first, "high": last}.get(pull, (first + last) / 2.0)
    spread = (low + high) / 2.0 - size / 2.0
    free = low.isNull() | (size >= 1.0 - EPS)
    wanted = F.when(free, centred).when(high - low <= size + EPS, fitting).otherwise(spread)
    return F.least(F.greatest(wanted, F.lit(0.0)), slack)


def padded_span(boxes: Column | str) -> Column:
    """struct(x0, x1, y0, y1) around all padded boxes, null ends without boxes."""

    def ends(safe: Column) -> Column:
        def low(axis: str) -> Column:
            return F.array_min(F.transform(safe, lambda b: b[axis]))

        def high(axis: str, extent: str) -> Column:
            return F.array_max(F.transform(safe, lambda b: b[axis] + b[extent]))

        return F.struct(
            low("x").alias("x0"), high("x", "w").alias("x1"), low("y").alias("y0"), high("y", "h").alias("y1")
        )

    return let(pad_boxes(boxes), ends)


def cover_crop(
    photo_aspect: Column | str,
    frame_aspect: Column | str,
    boxes: Column | str | None = None,
    pull_x: str | None = None,
    span: Column | None = None,
) -> Column:
    """Crop that fills the frame and keeps padded faces in view; pull_x: low, high or None.

    ``span`` is the ``padded_span`` of the boxes, for callers that crop one photo many times.
    """
    photo = F.when(col(photo_aspect) > 0, col(photo_aspect)).otherwise(1.0)
    frame = F.when(col(frame_aspect) > 0, col(frame_aspect)).otherwise(1.0)
    wide = photo > frame
    w = F.least(F.when(wide, frame / photo).otherwise(1.0), F.lit(1.0))
    h = F.least(F.when(wide, F.lit(1.0)).otherwise(photo / frame), F.lit(1.0))
    span = padded_span(boxes) if span is None else span
    return let(
        F.struct(w.alias("w"), h.alias("h"), span.alias("s")),
        lambda v: box(
            _window_start(v["w"], v["s"]["x0"], v["s"]["x1"], pull_x),
            _window_start(v["h"], v["s"]["y0"], v["s"]["y1"], None),
            v["w"],
            v["h"],
        ),
    )


def crop_loss(boxes: Column | str, crop: Column | str) -> Column:
    """Share of the face area outside ``crop`` (a box), 0 without faces."""
    faces = col(boxes)

    def kept(b: Column, window: Column) -> Column:
        w = F.least(b["x"] + b["w"], window["x"] + window["w"]) - F.greatest(b["x"], window["x"])
        h = F.least(b["y"] + b["h"], window["y"] + window["h"]) - F.greatest(b["y"], window["y"])
        return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))

    whole = total(faces, lambda b: b["w"] * b["h"])
    inside = let(col(crop), lambda window: total(faces, lambda b: kept(b, window)))
    return F.when(whole > 0, clamp(1.0 - inside / whole, 0.0, 1.0)).otherwise(F.lit(0.0))


def crop_losses(boxes: Column | str, photo_aspect: Column | str, frames: Sequence[float]) -> Column:
    """``crop_loss`` of the ``cover_crop`` of one photo into each of a few frame aspects, as an array.

    An Arrow kernel over the boxes of many photos at once; where an aspect or a box is null or not finite the column
    expressions decide.
    """
    shapes = [float(f) if f > 0 else 1.0 for f in frames]

    @F.arrow_udf("array<double>")
    def losses(photos: pa.Array, listed: pa.Array) -> pa.Array:
        def doubles(values):
            return values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # null: nan

        sizes = np.asarray(listed.value_lengths().fill_null(0), dtype=np.int64)
        flat = listed.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        x, y, w, h = (doubles(flat.field(k)) for k in ("x", "y", "w", "h"))
        aspect = doubles(photos)
        odd = ~np.isfinite(aspect) | np.asarray(listed.is_null())
        odd[row[~np.isfinite(x + y + w + h)]] = True
        photo = np.where(aspect > 0, aspect, 1.0)
        filled = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[filled]

        def span(at, size, before, after):
            low = np.maximum(0.0, at - size * before)
            high = low + (np.minimum(1.0, at + size * (1.0 + after)) - low)
            ends = np.zeros((2, len(sizes)))
            if len(filled):
                ends[0, filled], ends[1, filled] = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            return ends

        def start(size, low, high):
            slack = np.maximum(0.0, 1.0 - size)
            a, b = np.maximum(0.0, high - size), np.minimum(slack, low)
            fitting = (np.minimum(a, b) + np.maximum(a, b)) / 2.0
            wanted = np.where(high - low <= size + EPS, fitting, (low + high) / 2.0 - size / 2.0)
            wanted = np.where(size >= 1.0 - EPS, (1.0 - size) / 2.0, wanted)
            return np.minimum(np.maximum(wanted, 0.0), slack)

        out = np.zeros((len(sizes), len(shapes)))
        with np.errstate(all="ignore"):
            across, down = span(x, w, PAD_SIDE, PAD_SIDE), span(y, h, PAD_UP, PAD_DOWN)
            whole = np.bincount(row, w * h, len(sizes))
            for k, frame in enumerate(shapes):
                wide = photo > frame
                cw = np.minimum(np.where(wide, frame / photo, 1.0), 1.0)
                ch = np.minimum(np.where(wide, 1.0, photo / frame), 1.0)
                cx, cy = start(cw, *across), start(ch, *down)
                iw = np.minimum(x + w, (cx + cw)[row]) - np.maximum(x, cx[row])
                ih = np.minimum(y + h, (cy + ch)[row]) - np.maximum(y, cy[row])
                inside = np.bincount(row, np.where((iw > 0) & (ih > 0), iw * ih, 0.0), len(sizes))
                out[:, k] = np.where(whole > 0, np.maximum(0.0, np.minimum(1.0, 1.0 - inside / whole)), 0.0)
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * len(shapes)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(odd))

    each = F.transform(F.lit(shapes), lambda frame: crop_loss(boxes, cover_crop(photo_aspect, frame, boxes)))
    return F.coalesce(losses(col(photo_aspect), col(boxes)), each)


# Head size in units of the distance between the eyes.
HEAD_WIDTH, CROWN, CHIN = 2.2, 1.5, 2.6


def box_from_eyes(left_x: Column, left_y: Column, right_x: Column, right_y: Column) -> Column:
    """Full-head box from the two eye points, or null when they coincide or leave the frame."""
    cx, cy = (left_x + right_x) / 2.0, (left_y + right_y) / 2.0
    dx, dy = right_x - left_x, right_y - left_y
    eyes = F.sqrt(dx * dx + dy * dy)
    x0 = F.greatest(F.lit(0.0), cx - eyes * HEAD_WIDTH / 2.0)
    y0 = F.greatest(F.lit(0.0), cy - eyes * CROWN)
    x1 = F.least(F.lit(1.0), cx + eyes * HEAD_WIDTH / 2.0)
    y1 = F.least(F.lit(1.0), cy + eyes * CHIN)
    return F.when((eyes > 0) & (x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


# Proportions of an identity photo.
HEAD_SPAN, EYE_LINE_IN_FACE, HEAD_FRACTION, EYE_LINE_FRACTION = 1.8, 0.35, 0.65, 0.45


def id_crop(width: Column, height: Column, face: Column | str, aspect: Column | float) -> Column:
    """Pixel rectangle of an identity photo around ``face``; centred when there is none."""
    face = col(face)
    aspect = F.lit(aspect) if isinstance(aspect, (int, float)) else aspect
    fw, fh = face["w"] * width, face["h"] * height
    found = F.coalesce((fw > 0) & (fh > 0), F.lit(False))

    ideal_h = fh * HEAD_SPAN / HEAD_FRACTION
    ideal_w = ideal_h * aspect
    fit = F.least(F.lit(1.0), width / ideal_w, height / ideal_h)
    free_h = F.least(height, width / aspect)
    h = F.when(found, ideal_h * fit).otherwise(free_h)
    w = F.when(found, ideal_w * fit).otherwise(free_h * aspect)

    def held(wanted: Column, room: Column) -> Column:
        return F.when(room < 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(room, wanted))
        )

    centre_x = face["x"] * width + fw / 2.0
    eye_y = face["y"] * height + fh * EYE_LINE_IN_FACE
    x0 = F.when(found, held(centre_x - w / 2.0, width - w)).otherwise((width - w) / 2.0)
    y0 = F.when(found, held(eye_y - h * EYE_LINE_FRACTION, height - h)).otherwise((height - h) / 2.0)
    whole = lambda v: F.rint(v).cast("long")
    return F.struct(
        whole(x0).alias("x0"), whole(y0).alias("y0"),
        whole(x0 + w).alias("x1"), whole(y0 + h).alias("y1"),
    )


# Fixed value: margin around the faces of a composed crop.
GROUP_MARGIN = 0.35


def nearest_third(x: Column) -> Column:
    near = F.abs(x - F.lit(1.0) / 3.0) <= F.abs(x - F.lit(2.0) / 3.0)
    return F.when(near, F.lit(1.0) / 3.0).otherwise(F.lit(2.0) / 3.0)


def slide_into_unit(low: Column, high: Column) -> tuple[Column, Column]:
    """Move an interval into [0, 1]; one that is too wide becomes [0, 1]."""
    width = high - low
    start = F.when((width >= 1.0) | (low < 0.0), F.lit(0.0)).when(high > 1.0, 1.0 - width).otherwise(low)
    end = F.when((width >= 1.0) | ((high > 1.0) & (low >= 0.0)), F.lit(1.0)).when(low < 0.0, width).otherwise(high)
    return start, end


def third_rule_crop(boxes: Column | str) -> Column:
    """Crop around all faces with a margin, its centre pulled to a third line; null without."""
    faces = col(boxes)

    def placed(s: Column) -> Column:
        size = (s["high"] + (s["high"] - s["low"]) * GROUP_MARGIN) - (s["low"] - (s["high"] - s["low"]) * GROUP_MARGIN)
        centre = (s["low"] + s["high"]) * 0.5
        return let(
            F.struct(size.alias("size"), centre.alias("centre"), s["low"].alias("low"), s["high"].alias("high")),
            lambda v: let(
                F.struct(
                    v["size"].alias("size"),
                    F.greatest(
                        v["high"] - v["size"],
                        F.least(v["low"], v["centre"] - nearest_third(v["centre"]) * v["size"]),
                    ).alias("start"),
                ),
                lambda w: _unit_interval(w["start"], w["start"] + w["size"]),
            ),
        )

    def along(axis: str, extent: str) -> Column:
        low = F.array_min(F.transform(faces, lambda b: F.greatest(F.lit(0.0), b[axis])))
        high = F.array_max(F.transform(faces, lambda b: F.least(F.lit(1.0), b[axis] + b[extent])))
        return let(F.struct(low.alias("low"), high.alias("high")), placed)

    whole = let(
        F.struct(along("x", "w").alias("x"), along("y", "h").alias("y")),
        lambda p: box(p["x"]["low"], p["y"]["low"], p["x"]["high"] - p["x"]["low"], p["y"]["high"] - p["y"]["low"]),
    )
    return F.when(F.size(faces) > 0, whole)


def _unit_interval(low: Column, high: Column) -> Column:
    start, end = slide_into_unit(low, high)
    return F.struct(start.alias("low"), end.alias("high"))


# -- description of a photo -------------------------------------------------- #
def orientation(aspect: Column | str) -> Column:
    a = col(aspect)
    return (
        F.when((a <= 0) | (F.abs(a - 1.0) <= 0.05), "square")
        .when(a > 1.0, "landscape")
        .otherwise("portrait")
    )


def composition(boxes: Column | str, aspect: Column | str) -> Column:
    n = F.size(col(boxes))
    face = area(F.get(col(boxes), F.lit(0)))
    return (
        F.when(n == 0, "landscape")
        .when(n >= 5, "large_group")
        .when(n >= 2, "group")
        .when(face >= 0.08, "portrait")
        .when((face <= 0.06) & (orientation(aspect) == "portrait"), "full_body")
        .when(face >= 0.02, "environmental")
        .otherwise("detail")
    )


def content_profile(boxes: Column | str, aspect: Column | str) -> Column:
    """Face count, largest face, face centres, composition and orientation as one struct."""
    b = col(boxes)
    return F.struct(
        F.size(b).cast("long").alias("face_count"),
        F.coalesce(F.array_max(F.transform(b, area)), F.lit(0.0)).alias("dominant_face"),
        F.transform(
            b, lambda r: F.struct((r["x"] + r["w"] / 2.0).alias("cx"), (r["y"] + r["h"] / 2.0).alias("cy"))
        ).alias("centres"),
        composition(boxes, aspect).alias("composition"),
        orientation(aspect).alias("orientation"),
    )


def effective_ppi(width: Column, height: Column, cell_w: Column, cell_h: Column, dpi: int) -> Column:
    """Print resolution of a photo in its cell; null for an empty cell."""
    return F.when((cell_w > 0) & (cell_h > 0), F.least(width / cell_w, height / cell_h) * dpi)
