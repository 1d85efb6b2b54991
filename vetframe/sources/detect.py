"""Which format a folder holds, and reading any of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import model
from . import coco, files, voc, yolo


def detect_format(spark: SparkSession, root: str) -> str | None:
    if any(files.read_text(spark, f"{root.rstrip('/')}/{n}") is not None for n in yolo.DESCRIPTIONS):
        return "yolo"
    if coco.discover(spark, root):
        return "coco"
    return "voc" if voc.annotation_dir(spark, root) else None


def read_dataset(spark: SparkSession, root: str, format: str | None = None, task: str | None = None) -> model.Tables:
    kind = format or detect_format(spark, root)
    if kind == "yolo":
        return yolo.read(spark, root, task)
    if kind in ("coco", "voc"):
        return {"coco": coco, "voc": voc}[kind].read(spark, root)
    raise ValueError(f"no known dataset format in {root}")
