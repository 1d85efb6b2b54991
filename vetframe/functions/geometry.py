"""Corner, area, polygon and overlap expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vertices up to which edges are compared pairwise.
MAX_CHECKED_VERTICES = 160
CROSS_EPS = 1e-12


def corners(xc="xc", yc="yc", w="w", h="h") -> dict[str, Column]:
    c = F.col
    return {"x1": c(xc) - c(w) / 2, "y1": c(yc) - c(h) / 2, "x2": c(xc) + c(w) / 2, "y2": c(yc) + c(h) / 2}


def shoelace(polygon: Column) -> Column:
    """Signed area; 0 below three vertices."""
    n = F.size(polygon)

    def term(p: Column, i: Column) -> Column:
        q = F.get(polygon, (i + 1) % n)
        return p["x"] * q["y"] - q["x"] * p["y"]

    total = F.aggregate(F.transform(polygon, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 3, F.lit(0.0)).otherwise(total / 2)


def _turn(a: Column, b: Column, c: Column) -> Column:
    v = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    return F.when(v > CROSS_EPS, 1).when(v < -CROSS_EPS, -1).otherwise(0)


def self_intersects(polygon: Column) -> Column:
    """Two edges that share no vertex cross properly; only polygons of 4 to 160 vertices are compared."""
    n = F.size(polygon)
    at = lambda i: F.get(polygon, i % n)

    def crosses(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        return (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)

    def any_after(i: Column) -> Column:
        # the edge before the first one is its neighbour
        last = F.when(i == 0, n - 2).otherwise(n - 1)
        return F.when(i + 2 <= last, F.exists(F.sequence(i + 2, last), lambda j: crosses(i, j))).otherwise(F.lit(False))

    checked = (n >= 4) & (n <= MAX_CHECKED_VERTICES)
    return F.when(checked, F.exists(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), any_after)).otherwise(F.lit(False))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of corner boxes; 0 without overlap, negative sides count as 0."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(zero, r["x2"] - r["x1"]) * F.greatest(zero, r["y2"] - r["y1"])
    union = area(a) + area(b) - inter
    return F.when((inter <= 0) | (union <= 0), zero).otherwise(inter / union)


def snap(value: Column, extent: Column) -> Column:
    """Half a pixel beyond either border is rounding, not an error."""
    return F.when(extent <= 0, value).when((value > -0.5) & (value < 0), F.lit(0.0)).when((value > extent) & (value < extent + 0.5), extent.cast("double")).otherwise(value)


def polygon_width(n_fields: Column) -> Column:
    """Whether a row of so many fields can be a class and a polygon."""
    return (n_fields >= 7) & ((n_fields - 1) % 2 == 0)


def micro(column: Column) -> Column:
    """A coordinate in millionths: equal after rounding to six places means equal here."""
    return F.round(column * 1_000_000).cast("long")
