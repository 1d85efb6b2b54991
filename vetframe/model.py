"""Schemas of the canonical tables, and the bundle that detectors read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

SAMPLES = "split string, stem string, key string, image_path string, label_path string, label_exists boolean, n_boxes int, n_parse_errors int"
POLYGON = "array<struct<x:double,y:double>>"
KEYPOINTS = "array<struct<x:double,y:double,v:double>>"
BOXES = f"key string, split string, stem string, line_no int, cls int, xc double, yc double, w double, h double, raw string, polygon {POLYGON}, keypoints {KEYPOINTS}"
PARSE_ERRORS = "key string, line_no int, raw string, reason string"
IMAGES = "key string, path string, size bigint, width int, height int, image_error string, dhash bigint, sha1 string, exif_orientation int, has_gps boolean"
TAXONOMY = "cls int, name string"
HITS = "type string, detector string, key string, line_no int, note string"
MANIFEST = "path string, size bigint, sha1 string"


@dataclass
class Meta:
    """What the description file of a dataset says, and what was inferred."""

    root: str = ""
    task: str = "detect"
    task_source: str = "default"
    names: list[str] = field(default_factory=list)
    yaml_error: str | None = None
    n_kpt: int = 0
    kpt_dim: int = 3
    has_license: bool = True
    imgsz: int = 640
    max_det: int = 300

    @property
    def nc(self) -> int:
        return len(self.names)


@dataclass
class Tables:
    """The canonical tables of one dataset; a table that a source lacks is None."""

    meta: Meta
    samples: DataFrame
    boxes: DataFrame
    parse_errors: DataFrame | None = None
    images: DataFrame | None = None
    taxonomy: DataFrame | None = None
    predictions: DataFrame | None = None

    def with_training(self, imgsz: int | None = None, max_det: int | None = None) -> Tables:
        changes = {k: v for k, v in (("imgsz", imgsz), ("max_det", max_det)) if v is not None}
        return replace(self, meta=replace(self.meta, **changes))
