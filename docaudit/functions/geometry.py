"""Boxes in page points with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page height used when the layout does not state one, and page width fallback.
DEFAULT_PAGE_HEIGHT = 842.0
DEFAULT_PAGE_WIDTH = 600.0

BOX = ("x0", "y0", "x1", "y1")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def area_of(box: Column) -> Column:
    return area(*(box[k] for k in BOX))


def valid_box(box: Column) -> Column:
    return F.coalesce((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.lit(False))


def column_band(x0: Column, x1: Column, width: Column) -> Column:
    """Horizontal band of a block on its page."""
    mid = (x0 + x1) / 2.0
    return (
        F.when(mid < width / 3.0, "left")
        .when(mid > width / 3.0 * 2.0, "right")
        .when(x1 - x0 > width * 0.55, "full")
        .otherwise("center")
    )
