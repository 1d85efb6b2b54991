"""Fixes as transformations of the box table.  Steps compose: each works on what the last one left."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry as G
from . import rows


def drop_degenerate(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    return boxes.where(~rows.degenerate())


def drop_tiny(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """What the check calls tiny goes, by area as by side, so a later check finds none."""
    return boxes.where(~rows.tiny())


def clip(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Corners are moved onto the frame; boxes that collapse go."""
    c = G.corners()
    inside = {k: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for k, v in c.items()}
    b = boxes.withColumns({f"__{k}": v for k, v in inside.items()}).where("__x2 > __x1 AND __y2 > __y1")
    new = {"xc": "(__x1 + __x2) / 2", "yc": "(__y1 + __y2) / 2", "w": "__x2 - __x1", "h": "__y2 - __y1"}
    return b.withColumns({k: F.expr(v) for k, v in new.items()}).drop("__x1", "__y1", "__x2", "__y2")


def dedupe(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    return rows.without_repeats(boxes)


def normalise(boxes: DataFrame, images: DataFrame | None) -> DataFrame:
    """Rows with a value beyond 1.5 are divided by the size of their image, where it is known."""
    if images is None:
        return boxes
    sized = boxes.join(images.where("width > 0 AND height > 0").select("key", "width", "height"), "key", "left")
    large = (F.greatest("xc", "yc", "w", "h") > 1.5) & F.col("width").isNotNull()
    for c, by in (("xc", "width"), ("yc", "height"), ("w", "width"), ("h", "height")):
        sized = sized.withColumn(f"__{c}", F.when(large, F.col(c) / F.col(by)).otherwise(F.col(c)))
    return sized.drop("xc", "yc", "w", "h", "width", "height").withColumnsRenamed({f"__{c}": c for c in ("xc", "yc", "w", "h")}).select(*boxes.columns)


def keep_parsed(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Rows that could not be parsed are no boxes, so writing the boxes drops them."""
    return boxes


ACTIONS = {
    "drop_degenerate_boxes": drop_degenerate,
    "drop_tiny_boxes": drop_tiny,
    "clip_or_drop_boxes": clip,
    "dedupe_annotations": dedupe,
    "normalise_coordinates": normalise,
    "repair_or_drop_rows": keep_parsed,
}


def automatable(steps: Iterable[dict]) -> list[dict]:
    """Steps that may run without a human: a known action, and no review asked for."""
    return [s for s in steps if s.get("action") in vocab.AUTOMATABLE and not s.get("requires_human_review")]


def apply_steps(boxes: DataFrame, steps: Iterable[dict], images: DataFrame | None = None, task: str = "detect") -> DataFrame:
    """All box actions of a plan, one upon another, in the plan's order."""
    for s in automatable(steps):
        if s["action"] in ACTIONS:
            if task != "detect" and s["action"] in ("clip_or_drop_boxes", "normalise_coordinates"):
                raise ValueError(f"{s['action']} would part the boxes of a {task} dataset from their shapes")
            boxes = ACTIONS[s["action"]](boxes, images)
    return boxes
