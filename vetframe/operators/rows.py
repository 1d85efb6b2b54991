"""Checks of single boxes and label rows, fused into one pass.

Each check is a predicate over a row; ``row_hits`` evaluates all of them in one
projection and explodes the few that hold, so a dataset is scanned once however
many checks run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

EPS = 1e-9
TINY_SIDE, TINY_AREA = 0.003, 1e-5
WHOLE_SIDE, WHOLE_LEAST, WHOLE_SHARE = 0.98, 5, 0.02
DETECTABLE_PIXELS = 8
ZERO_AREA = 1e-9
KEYPOINT_MARGIN = 0.02


def degenerate() -> Column:
    return (F.col("w") <= EPS) | (F.col("h") <= EPS)


def tiny() -> Column:
    w, h = F.col("w"), F.col("h")
    return ~degenerate() & ((w < TINY_SIDE) | (h < TINY_SIDE) | (w * h < TINY_AREA))


def out_of_bounds() -> Column:
    c = G.corners()
    beyond = (c["x1"] < -EPS) | (c["y1"] < -EPS) | (c["x2"] > 1 + EPS) | (c["y2"] > 1 + EPS)
    for centre in ("xc", "yc"):
        beyond = beyond | (F.col(centre) < -EPS) | (F.col(centre) > 1 + EPS)
    return beyond


def class_out_of_range(nc: int) -> Column:
    return (F.col("cls") < 0) | (F.col("cls") >= nc) if nc > 0 else F.col("cls") < 0


def undetectable(imgsz: int = 640) -> Column:
    w, h, least = F.col("w"), F.col("h"), DETECTABLE_PIXELS / imgsz
    return (w > 0) & (h > 0) & ((w < least) | (h < least))


def whole_frame() -> Column:
    return (F.col("w") >= WHOLE_SIDE) & (F.col("h") >= WHOLE_SIDE)


def polygon_checks() -> dict[str, Column]:
    """A crossing polygon has no area of its own, so the area is judged only without one."""
    p = F.col("polygon")
    has, n, crossing = p.isNotNull(), F.size(p), G.self_intersects(p)
    enough = has & (n >= 3)
    return {
        "polygon_too_few_points": has & (n < 3),
        "polygon_self_intersecting": enough & crossing,
        "polygon_unverified": enough & (n > G.MAX_CHECKED_VERTICES),
        "polygon_zero_area": enough & ~crossing & (F.abs(G.shoelace(p)) <= ZERO_AREA),
    }


def row_hits(boxes: DataFrame, checks: dict[str, Column], keep: Sequence[str] = ("key", "line_no")) -> DataFrame:
    """(type, *keep) for each check that holds on each row: one scan."""
    found = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in checks.items())))
    return boxes.select(*keep, F.explode(found).alias("type")).select("type", *keep)


def geometry_checks(nc: int = 0) -> dict[str, Column]:
    return {"degenerate_box": degenerate(), "tiny_box": tiny(), "out_of_bounds": out_of_bounds(), "class_id_out_of_range": class_out_of_range(nc)}


def repeats(boxes: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row of their file, with the line of the first."""
    same = Window.partitionBy("key", "cls", *(G.micro(F.col(c)) for c in ("xc", "yc", "w", "h"))).orderBy("line_no")
    marked = boxes.withColumns({"place": F.row_number().over(same), "first_line": F.first("line_no").over(same)})
    return marked.where("place > 1").drop("place")


def without_repeats(boxes: DataFrame) -> DataFrame:
    same = Window.partitionBy("key", "cls", *(G.micro(F.col(c)) for c in ("xc", "yc", "w", "h"))).orderBy("line_no")
    return boxes.withColumn("place", F.row_number().over(same)).where("place = 1").drop("place")


def keypoint_hits(boxes: DataFrame) -> DataFrame:
    """(type, key, line_no, point): flags that are none of 0, 1, 2, and labelled points beside their box."""
    c, m = G.corners(), KEYPOINT_MARGIN
    points = boxes.select("key", "line_no", *(v.alias(k) for k, v in c.items()), F.posexplode("keypoints").alias("point", "p"))
    v, x, y = F.col("p.v"), F.col("p.x"), F.col("p.y")
    beside = v.isin(1.0, 2.0) & ((x < F.col("x1") - m) | (x > F.col("x2") + m) | (y < F.col("y1") - m) | (y > F.col("y2") + m))
    return row_hits(points, {"keypoint_visibility_invalid": ~v.isin(0.0, 1.0, 2.0), "keypoint_outside_box": beside}, ("key", "line_no", "point"))


def whole_frame_hits(boxes: DataFrame) -> DataFrame:
    """Whole-frame boxes, if there are 5 or more and they are 2 % of all boxes or more."""
    gate = boxes.agg(F.count_if(whole_frame()).alias("n"), F.count("*").alias("total")).where(f"n >= {WHOLE_LEAST} AND n >= {WHOLE_SHARE} * total")
    return boxes.where(whole_frame()).select(F.lit("whole_frame_box").alias("type"), "key", "line_no").join(F.broadcast(gate.select()), how="cross")  # one row at most


def over_max_detections(boxes: DataFrame, max_det: int = 300) -> DataFrame:
    return boxes.groupBy("key").agg(F.count("*").alias("n_boxes")).where(F.col("n_boxes") > max_det)


def denormalised(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(key, n_over, n_boxes) of files whose large values look like pixels of their image.

    Files are reduced to one row, and only those with large values meet the images.
    """
    over = F.greatest("xc", "yc", "w", "h") > 1.5
    files = boxes.groupBy("key").agg(
        F.count_if(over).alias("n_over"), F.count("*").alias("n_boxes"), F.max(F.when(over, F.greatest("xc", "w"))).alias("far_x"), F.max(F.when(over, F.greatest("yc", "h"))).alias("far_y")
    )
    files = files.where(F.col("n_over") >= F.greatest(F.lit(1), F.floor(F.col("n_boxes") / 2)))
    sized = images.where("width > 0 AND height > 0").select("key", "width", "height")
    return files.join(sized, "key").where("far_x <= 1.02 * width AND far_y <= 1.02 * height").select("key", "n_over", "n_boxes")
