"""Boxes: four double columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box_key(box: tuple[Column, ...], step: float = 0.5) -> list[Column]:
    """Quantised sides, half to even."""
    return [F.bround(c / step).cast("long") for c in box]


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the area of ``a`` that ``b`` covers; 0 for an empty ``a``."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def of(prefix: str = "") -> tuple[Column, ...]:
    """The four side columns of a table, or of a struct or alias with a dot."""
    return tuple(F.col(prefix + s) for s in SIDES)
