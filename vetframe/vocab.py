"""The closed vocabulary of findings: severity, category and the action that mends each type."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("critical", "major", "minor")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
GOVERNANCE = frozenset(("representation_skew", "missing_license", "gps_metadata"))

_BY_SEVERITY = {
    "critical": """polygon_zero_area polygon_too_few_points polygon_self_intersecting malformed_label_row
        train_val_leakage exif_orientation corrupt_image class_id_out_of_range degenerate_box denormalised_coords out_of_bounds""",
    "major": """gps_metadata missing_license split_ratio_extreme class_absent_from_val template_annotation
        over_max_detections undetectable_at_imgsz keypoint_visibility_invalid yaml_inconsistency extreme_class_imbalance
        tiny_box near_duplicate_image missing_label_file duplicate_annotation class_swap""",
    "minor": "representation_skew whole_frame_box keypoint_outside_box polygon_unverified orphan_label_file empty_label_file",
}
SEVERITY = {name: severity for severity, names in _BY_SEVERITY.items() for name in names.split()}

#: What to do about a type; the automatable ones can be applied without a human.
ACTION = {
    "degenerate_box": "drop_degenerate_boxes",
    "tiny_box": "drop_tiny_boxes",
    "out_of_bounds": "clip_or_drop_boxes",
    "duplicate_annotation": "dedupe_annotations",
    "denormalised_coords": "normalise_coordinates",
    "malformed_label_row": "repair_or_drop_rows",
    "orphan_label_file": "delete_orphan_labels",
    "corrupt_image": "remove_corrupt_images",
    "exif_orientation": "strip_exif_metadata",
    "gps_metadata": "strip_exif_metadata",
}
AUTOMATABLE = frozenset(ACTION.values())
NEEDS_HUMAN = frozenset(("extreme_class_imbalance", "empty_label_file", "class_swap"))

TRAIN_NAMES = ("train", "train2017", "training")
VAL_NAMES = ("val", "valid", "val2017", "validation", "test")

EVIDENCE_CAP = {"structure_scan": 10, "class_scan": 15, "duplicate_scan": 15, "split_scan": 15}


class Kind(NamedTuple):
    type: str
    severity: str
    severity_rank: int
    category: str
    action: str | None


def kinds() -> list[Kind]:
    return [Kind(t, s, RANK[s], "governance" if t in GOVERNANCE else "trainability", ACTION.get(t)) for t, s in sorted(SEVERITY.items())]


def table(spark: SparkSession) -> DataFrame:
    """32 rows: a fixed number, so joins may broadcast it."""
    return spark.createDataFrame(kinds(), "type string, severity string, severity_rank int, category string, action string")


def role(split: str) -> str:
    """Train, val or other, by the lower-cased name of a split."""
    low = split.lower()
    return "train" if low in TRAIN_NAMES else "val" if low in VAL_NAMES else "other"
