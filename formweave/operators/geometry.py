"""Regions of a page in fractions (origin top left), as Column builders; ink bounds and turns over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNER, BAND, LEAST_SIDE = 0.40, 0.70, 0.02
ZONES = tuple(f"{v}-{h}" for v in ("top", "middle", "bottom") for h in ("left", "center", "right"))


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def for_zone(name: Column, corner: float = CORNER, band: float = BAND) -> Column:
    """The region of a zone: corners and bands at the edges; anything else is the full page."""
    vertical, horizontal = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(2))
    w = F.when(horizontal == "center", band).otherwise(corner)
    h = F.when(vertical == "middle", band).otherwise(corner)
    x = F.when(horizontal == "left", 0.0).when(horizontal == "right", 1 - w).otherwise((1 - w) / 2)
    y = F.when(vertical == "top", 0.0).when(vertical == "bottom", 1 - h).otherwise((1 - h) / 2)
    known = F.coalesce(name.isin(*[z for z in ZONES if z != "middle-center"]), F.lit(False))
    full = region(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)))
    return F.when(known, region(x, y, w, h)).otherwise(full)


def from_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The box clamped to the page; null if a side is shorter than ``LEAST_SIDE``."""
    x, y = _clamp(left), _clamp(top)
    w, h = _clamp(right) - x, _clamp(bottom) - y
    return F.when((w >= LEAST_SIDE) & (h >= LEAST_SIDE), region(x, y, w, h))


def expanded(r: Column, margin: Column) -> Column:
    x, y = _clamp(r["x"] - margin), _clamp(r["y"] - margin)
    return region(x, y, _clamp(r["x"] + r["w"] + margin) - x, _clamp(r["y"] + r["h"] + margin) - y)


def within(inner: Column, outer: Column) -> Column:
    """A region given in fractions of another, in fractions of the page."""
    placed = region(outer["x"] + inner["x"] * outer["w"], outer["y"] + inner["y"] * outer["h"], inner["w"] * outer["w"], inner["h"] * outer["h"])
    return F.when(outer.isNull(), inner).otherwise(placed)


def zone_of(r: Column) -> Column:
    """The cell of a three by three grid that holds the centre."""
    x, y = r["x"] + r["w"] / 2, r["y"] + r["h"] / 2
    third = lambda v, low, mid, high: F.when(v < 1 / 3, low).when(v > 2 / 3, high).otherwise(mid)
    return F.concat_ws("-", third(y, "top", "middle", "bottom"), third(x, "left", "center", "right"))


def target_region(box: Column, ink: Column, large: Column) -> Column:
    """A located box on the page's ink, with a margin; null without a box, or if it covers too much of the page."""
    placed = within(box, ink)
    wide = expanded(placed, F.greatest(F.lit(0.02), 0.05 * F.greatest(placed["w"], placed["h"])))
    return F.when(box.isNotNull() & (wide["w"] * wide["h"] <= F.when(large, 0.35).otherwise(0.70)), wide)


def named_zone(corner: Column, box: Column) -> Column:
    return F.coalesce(corner, zone_of(box))


def ink_bounds(pixels: DataFrame, sizes: DataFrame, level: int = 240, least: int = 3) -> DataFrame:
    """``img_id, x, y, w, h``: the bounds of rows and columns with ``least`` dark pixels, widened by a hundredth.

    ``pixels`` has img_id, x, y, level and ``sizes`` img_id, width, height. Where the bounds cover 0.6 of the page
    or more, or there is no ink, the full page is returned.
    """
    dark = pixels.where(F.col("level") <= level)

    def span(axis: str) -> DataFrame:
        full = dark.groupBy("img_id", axis).count().where(F.col("count") >= least)
        return full.groupBy("img_id").agg(F.min(axis).alias(f"{axis}0"), (F.max(axis) + 1).alias(f"{axis}1"))

    rows = sizes.join(span("x"), "img_id", "left").join(span("y"), "img_id", "left")
    x, y = _clamp(F.col("x0") / F.col("width") - 0.01), _clamp(F.col("y0") / F.col("height") - 0.01)
    w, h = _clamp(F.col("x1") / F.col("width") + 0.01) - x, _clamp(F.col("y1") / F.col("height") + 0.01) - y
    small = F.col("x0").isNotNull() & F.col("y0").isNotNull() & (w * h < 0.60)
    pick = lambda v, full: F.when(small, v).otherwise(F.lit(full))
    return rows.select("img_id", pick(x, 0.0).alias("x"), pick(y, 0.0).alias("y"), pick(w, 1.0).alias("w"), pick(h, 1.0).alias("h"))


def turned(pixels: DataFrame, sizes: DataFrame, degrees: Column) -> DataFrame:
    """Pixels turned clockwise by quarter turns; other angles leave them as they are."""
    rows = pixels.join(sizes, "img_id").withColumn("__d", F.pmod(degrees, F.lit(360)))
    x = F.when(F.col("__d") == 90, F.col("height") - 1 - F.col("y")).when(F.col("__d") == 180, F.col("width") - 1 - F.col("x")).when(F.col("__d") == 270, F.col("y")).otherwise(F.col("x"))
    y = F.when(F.col("__d") == 90, F.col("x")).when(F.col("__d") == 180, F.col("height") - 1 - F.col("y")).when(F.col("__d") == 270, F.col("width") - 1 - F.col("x")).otherwise(F.col("y"))
    return rows.select("img_id", x.alias("x"), y.alias("y"), "level")


def cropped(pixels: DataFrame, sizes: DataFrame, r: Column) -> DataFrame:
    """The pixels inside a region, counted from its corner."""
    rows = pixels.join(sizes, "img_id").withColumn("__r", r)
    x0, y0 = F.round(F.col("__r.x") * F.col("width")), F.round(F.col("__r.y") * F.col("height"))
    w, h = F.greatest(F.round(F.col("__r.w") * F.col("width")), F.lit(1)), F.greatest(F.round(F.col("__r.h") * F.col("height")), F.lit(1))
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return rows.where(inside).select("img_id", (F.col("x") - x0).cast("int").alias("x"), (F.col("y") - y0).cast("int").alias("y"), "level")


def page_long_side_mm(width_pt: Column, height_pt: Column) -> Column:
    return F.greatest(width_pt, height_pt) / 72 * 25.4


def is_large(long_side_mm: Column) -> Column:
    return long_side_mm > 430


def unturned(r: Column, degrees: Column) -> Column:
    """A region of a page that is shown turned clockwise by quarter turns, on the page as it is stored."""
    x = F.when(degrees == 90, r["y"]).when(degrees == 180, 1 - r["x"] - r["w"]).when(degrees == 270, 1 - r["y"] - r["h"]).otherwise(r["x"])
    y = F.when(degrees == 90, 1 - r["x"] - r["w"]).when(degrees == 180, 1 - r["y"] - r["h"]).when(degrees == 270, r["x"]).otherwise(r["y"])
    side = degrees.isin(90, 270)
    return region(x, y, F.when(side, r["h"]).otherwise(r["w"]), F.when(side, r["w"]).otherwise(r["h"]))


def render_dpi(target_px: Column, side_mm: Column, cap: Column) -> Column:
    return F.least(F.greatest(F.least(target_px / (side_mm / 25.4), cap), F.lit(72.0)), F.lit(400.0))
