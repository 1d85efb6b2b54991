"""The built-in detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..model import Tables
from ..operators import classes, duplicates, rows, structure
from .registry import register

DATASET = "<dataset>"
COLUMNS = ("type", "key", "line_no", "note")
SHAPE = ["cls", "xc", "yc", "w", "h"]


def hits(*frames: DataFrame | None) -> DataFrame | None:
    """Union of frames with the columns of a hit; missing ones are null."""
    some = [f for f in frames if f is not None]
    if not some:
        return None
    kinds = {"line_no": "int"}
    full = [f.select(*(F.col(c).cast(kinds.get(c, "string")) if c in f.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS)) for f in some]
    return reduce(DataFrame.unionByName, full)


def dataset_hit(tables: Tables, type_: str, note: str) -> DataFrame:
    return tables.samples.sparkSession.createDataFrame([(type_, DATASET, None, note)], "type string, key string, line_no int, note string")


def per_class(df: DataFrame, type_: str, note) -> DataFrame:
    return df.select(F.lit(type_).alias("type"), F.lit(DATASET).alias("key"), note.alias("note"))


@register("structure_scan", "files that lack their partner, are empty or can't be parsed", covers=("missing_label_file", "orphan_label_file", "empty_label_file", "malformed_label_row", "yaml_inconsistency"))
def structure_scan(t: Tables) -> DataFrame | None:
    described = dataset_hit(t, "yaml_inconsistency", t.meta.yaml_error) if t.meta.yaml_error else None
    malformed = structure.malformed_rows(t.parse_errors) if t.parse_errors is not None else None
    return hits(structure.missing_labels(t.samples), structure.orphan_labels(t.samples), structure.empty_labels(t.samples), malformed, described)


@register("image_integrity_scan", "images that don't decode to the end", covers=("corrupt_image",), reads_pixels=True)
def image_integrity_scan(t: Tables) -> DataFrame | None:
    if t.images is None or "image_error" not in t.images.columns:
        return None
    return hits(structure.corrupt_images(t.images))


@register("geometry_scan", "boxes without extent, too small, outside or repeated", covers=("degenerate_box", "tiny_box", "out_of_bounds", "duplicate_annotation"))
def geometry_scan(t: Tables) -> DataFrame | None:
    checks = {"degenerate_box": rows.degenerate(), "tiny_box": rows.tiny(), "out_of_bounds": rows.out_of_bounds()}
    again = rows.repeats(t.boxes).select(F.lit("duplicate_annotation").alias("type"), "key", "line_no", F.concat(F.lit("as line "), F.col("first_line").cast("string")).alias("note"))
    return hits(rows.row_hits(t.boxes, checks), again)


@register("normalisation_scan", "files whose coordinates are pixels", covers=("denormalised_coords",))
def normalisation_scan(t: Tables) -> DataFrame | None:
    if t.images is None:
        return None
    found = rows.denormalised(t.boxes, t.images)
    return hits(found.select(F.lit("denormalised_coords").alias("type"), "key", F.format_string("%d of %d rows", "n_over", "n_boxes").alias("note")))


@register("class_scan", "class ids without a name, classes hardly seen", covers=("class_id_out_of_range", "extreme_class_imbalance"))
def class_scan(t: Tables) -> DataFrame | None:
    rare = classes.imbalance(t.boxes, t.meta.nc)
    note = F.format_string("class %d: %d train, %d val", "cls", "n_train", "n_val")
    return hits(rows.row_hits(t.boxes, {"class_id_out_of_range": rows.class_out_of_range(t.meta.nc)}), per_class(rare, "extreme_class_imbalance", note))


@register("class_distribution", "boxes of each class in each split", informational=True)
def class_distribution(t: Tables) -> DataFrame | None:
    return None if t.taxonomy is None else classes.distribution(t.boxes, t.taxonomy)


@register("duplicate_scan", "near copies within a split, and between train and val", covers=("train_val_leakage", "near_duplicate_image"), reads_pixels=True, heavy=True)
def duplicate_scan(t: Tables) -> DataFrame | None:
    if t.images is None or "hash" not in t.images.columns:
        return None
    hashed = t.images.select("key", F.regexp_extract("key", "^([^/]*)/", 1).alias("split"), "hash")
    leaked = duplicates.leaking_pairs(hashed).select(F.lit("train_val_leakage").alias("type"), "key", F.format_string("as %s, %d bits apart", "train_key", "d").alias("note"))
    near = duplicates.near_within_split(hashed).select(F.lit("near_duplicate_image").alias("type"), "key")
    return hits(leaked, near)


@register("polygon_scan", "polygons that cross themselves or enclose nothing", covers=("polygon_too_few_points", "polygon_self_intersecting", "polygon_unverified", "polygon_zero_area"))
def polygon_scan(t: Tables) -> DataFrame | None:
    return hits(rows.row_hits(t.boxes, rows.polygon_checks())) if t.meta.task == "segment" else None


@register("keypoint_scan", "key points with odd flags or beside their box", covers=("keypoint_visibility_invalid", "keypoint_outside_box"))
def keypoint_scan(t: Tables) -> DataFrame | None:
    return hits(rows.keypoint_hits(t.boxes)) if t.meta.task == "pose" else None


@register("split_scan", "splits that can't measure what they train", covers=("class_absent_from_val", "split_ratio_extreme"), group="split")
def split_scan(t: Tables) -> DataFrame | None:
    absent = per_class(classes.absent_from_val(t.boxes), "class_absent_from_val", F.format_string("class %d: %d train", "cls", "n_train"))
    ratio = per_class(classes.split_ratio(t.samples), "split_ratio_extreme", F.format_string("%d train, %d val", "n_train", "n_val"))
    return hits(absent, ratio)


@register("exif_orientation_scan", "images that viewers turn", covers=("exif_orientation",), group="metadata", reads_pixels=True)
def exif_orientation_scan(t: Tables) -> DataFrame | None:
    return hits(structure.rotated_images(t.images)) if t.images is not None and "exif_orientation" in t.images.columns else None


@register("privacy_scan", "positions in images, and a license for them", covers=("gps_metadata", "missing_license"), group="privacy", reads_pixels=True)
def privacy_scan(t: Tables) -> DataFrame | None:
    located = structure.located_images(t.images) if t.images is not None and "has_gps" in t.images.columns else None
    return hits(located, None if t.meta.has_license else dataset_hit(t, "missing_license", "no license file"))


@register("representation_scan", "classes seen in one kind of image only", covers=("representation_skew",), group="privacy", reads_pixels=True)
def representation_scan(t: Tables) -> DataFrame | None:
    if t.images is None:
        return None
    return hits(per_class(classes.representation_skew(t.boxes, t.images), "representation_skew", F.format_string("class %d in %s: %d of %d", "cls", "bucket", "in_bucket", "n")))


@register("training_fit_scan", "boxes that the training size hides, files beyond the detection limit", covers=("undetectable_at_imgsz", "over_max_detections"), group="training")
def training_fit_scan(t: Tables) -> DataFrame | None:
    small = rows.row_hits(t.boxes, {"undetectable_at_imgsz": rows.undetectable(t.meta.imgsz)})
    crowded = rows.over_max_detections(t.boxes, t.meta.max_det).select(F.lit("over_max_detections").alias("type"), "key", F.format_string("%d boxes", "n_boxes").alias("note"))
    return hits(small, crowded)


@register("provenance_scan", "boxes that a template made", covers=("template_annotation", "whole_frame_box"), group="annotations")
def provenance_scan(t: Tables) -> DataFrame | None:
    signed = t.boxes.withColumns({f"s_{c}": F.round(F.col(c) * 1_000_000).cast("long") for c in SHAPE[1:]})
    stamped = classes.template_hits(signed, ["cls", *(f"s_{c}" for c in SHAPE[1:])]).select(F.lit("template_annotation").alias("type"), "key", "line_no")
    return hits(stamped, rows.whole_frame_hits(t.boxes))


@register("model_disagreement_scan", "classes that a model names otherwise", covers=("class_swap",), experimental=True, heavy=True)
def model_disagreement_scan(t: Tables) -> DataFrame | None:
    if t.predictions is None:
        return None
    best = duplicates.best_overlap(t.boxes, t.predictions)
    swaps = duplicates.class_swaps(best)
    odd = best.where("iou >= 0.60 AND conf >= 0.55").join(F.broadcast(swaps.select("cls", "predicted")), ["cls", "predicted"])  # pairs of classes
    return hits(odd.select(F.lit("class_swap").alias("type"), "key", "line_no", F.format_string("%d as %d", "cls", "predicted").alias("note")))


def role_counts(t: Tables) -> DataFrame:
    return t.samples.groupBy(names.role(F.col("split")).alias("role")).agg(F.count("*").alias("n"))
