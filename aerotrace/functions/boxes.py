"""Overlap measures between axis-aligned boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYXY = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, ...]:
    """The four corner columns, optionally under an alias prefix such as ``a.``."""
    return tuple(F.col(f"{prefix}{c}") for c in XYXY)


def _inter(a, b) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def area(a) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def iou(a, b) -> Column:
    """Intersection over union; 0 for disjoint or touching boxes."""
    inter = _inter(a, b)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (area(a) + area(b) - inter))


def ioa(a, b) -> Column:
    """Share of box ``a`` that ``b`` covers (asymmetric)."""
    return _inter(a, b) / F.greatest(area(a), F.lit(1e-9))


def square_iou(cx1, cy1, s1, cx2, cy2, s2) -> Column:
    """Overlap of two squares given by centre and side, with the mean side as extent.

    Nested squares score higher than their true overlap; the tracker depends on that.
    """
    side = (s1 + s2) / 2
    inter = (F.greatest(side - F.abs(cx1 - cx2), F.lit(0.0))
             * F.greatest(side - F.abs(cy1 - cy2), F.lit(0.0)))
    return inter / (s1 * s1 + s2 * s2 - inter + 1e-6)
