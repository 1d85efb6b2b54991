"""Defects put into canonical tables on purpose, with the facts they make: for round-trip tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _change(boxes: DataFrame, keys: list[str], line: int, **values) -> DataFrame:
    hit = F.col("key").isin(keys) & (F.col("line_no") == line)
    return boxes.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def _facts(type_: str, keys: list[str]) -> set[tuple[str, str]]:
    return {(type_, k) for k in keys}


def out_of_bounds(boxes, keys, line=1):
    return _change(boxes, keys, line, xc=0.97, w=0.2), _facts("out_of_bounds", keys)


def degenerate(boxes, keys, line=1):
    return _change(boxes, keys, line, w=0.0), _facts("degenerate_box", keys)


def tiny(boxes, keys, line=1):
    return _change(boxes, keys, line, w=0.0005, h=0.0005), _facts("tiny_box", keys)


def bad_class(boxes, keys, nc, line=1):
    return _change(boxes, keys, line, cls=nc + 3), _facts("class_id_out_of_range", keys)


def repeat(boxes, keys, line=1):
    again = boxes.where(F.col("key").isin(keys) & (F.col("line_no") == line)).withColumn("line_no", F.col("line_no") + 1000)
    return boxes.unionByName(again), _facts("duplicate_annotation", keys)


def denormalise(boxes, keys, width, height):
    hit = F.col("key").isin(keys)
    for c, by in (("xc", width), ("w", width), ("yc", height), ("h", height)):
        boxes = boxes.withColumn(c, F.when(hit, F.col(c) * by).otherwise(F.col(c)))
    return boxes, _facts("denormalised_coords", keys)


def drop_class_from_val(boxes, cls):
    return boxes.where(~((F.col("cls") == cls) & (F.col("split") == "val"))), {("class_absent_from_val", "<dataset>")}


def template(boxes, keys, cls=0):
    """The same box in every file."""
    stamp = boxes.where(F.col("key").isin(keys)).groupBy("key").agg(*(F.first(c).alias(c) for c in boxes.columns if c != "key"))
    stamp = stamp.withColumns({"cls": F.lit(cls), "xc": F.lit(0.5), "yc": F.lit(0.5), "w": F.lit(0.25), "h": F.lit(0.25), "line_no": F.lit(2000)})
    return boxes.unionByName(stamp.select(*boxes.columns)), _facts("template_annotation", keys)
