"""Page geometry as column arithmetic: affine projection, IoU, distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def project_box(native: Column, page: Column) -> Column:
    """Native (bottom-left, unrotated) box -> displayed (top-left) box.

    `page` is STRUCT<width, height, rotation, crop STRUCT<left,bottom,right,top>>.
    Translate to the crop origin, turn clockwise, flip the y axis.
    """
    crop = page["crop"]
    crop_w, crop_h = crop["right"] - crop["left"], crop["top"] - crop["bottom"]
    left, right = native["x0"] - crop["left"], native["x1"] - crop["left"]
    low, high = native["y0"] - crop["bottom"], native["y1"] - crop["bottom"]
    height = page["height"]

    def by_rotation(r0: Column, r90: Column, r180: Column, r270: Column) -> Column:
        return (
            F.when(page["rotation"] == 0, r0)
            .when(page["rotation"] == 90, r90)
            .when(page["rotation"] == 180, r180)
            .when(page["rotation"] == 270, r270)
        )

    xa = by_rotation(left, low, crop_w - left, crop_h - low)
    xb = by_rotation(right, high, crop_w - right, crop_h - high)
    ya = height - by_rotation(low, crop_w - left, crop_h - low, left)
    yb = height - by_rotation(high, crop_w - right, crop_h - high, right)
    return F.when(
        native.isNotNull(),
        box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)),
    )


def page_is_consistent(page: Column) -> Column:
    """Displayed extents agree with the rotated crop box."""
    crop = page["crop"]
    crop_w, crop_h = crop["right"] - crop["left"], crop["top"] - crop["bottom"]
    upright = page["rotation"].isin(0, 180)
    want_w = F.when(upright, crop_w).otherwise(crop_h)
    want_h = F.when(upright, crop_h).otherwise(crop_w)
    return (
        page["rotation"].isin(0, 90, 180, 270)
        & (page["width"] > 0)
        & (page["height"] > 0)
        & (F.abs(page["width"] - want_w) <= TOLERANCE)
        & (F.abs(page["height"] - want_h) <= TOLERANCE)
    )


def box_reason(projected: Column, page: Column) -> Column:
    """Why a projected box is not a usable location, null when it is (or is missing)."""
    return (
        F.when(projected.isNull(), F.lit(None))
        .when(~page_is_consistent(page), F.lit("page_geometry_inconsistent"))
        .when(
            ~((projected["x0"] < projected["x1"]) & (projected["y0"] < projected["y1"])),
            F.lit("box_degenerate"),
        )
        .when(
            (projected["x0"] < -TOLERANCE)
            | (projected["y0"] < -TOLERANCE)
            | (projected["x1"] > page["width"] + TOLERANCE)
            | (projected["y1"] > page["height"] + TOLERANCE),
            F.lit("box_outside_page"),
        )
    )


def canonical_box(native: Column, page: Column) -> Column:
    """struct<bbox, reason>: bbox is null whenever a reason is given."""
    projected = project_box(native, page)
    reason = box_reason(projected, page)
    return F.struct(
        F.when(reason.isNull(), projected).alias("bbox"), reason.alias("reason")
    )


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / (area(a) + area(b) - w * h)


def center_distance(a: Column, b: Column) -> Column:
    """Manhattan distance of the two box centres."""
    return F.abs((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2) + F.abs(
        (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
    )
