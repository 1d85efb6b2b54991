"""Files: labels without images, images without labels, empty and unreadable ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(df: DataFrame, type_: str) -> DataFrame:
    return df.select(F.lit(type_).alias("type"), "key")


def pair(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and label files of one stem as one row: (key, has_image, label_exists)."""
    a, b = images.select("key", F.lit(True).alias("i")), labels.select("key", F.lit(True).alias("l"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("i", F.lit(False)).alias("has_image"), F.coalesce("l", F.lit(False)).alias("label_exists"))


def missing_labels(samples: DataFrame) -> DataFrame:
    return _hits(samples.where("image_path IS NOT NULL AND NOT label_exists"), "missing_label_file")


def orphan_labels(samples: DataFrame) -> DataFrame:
    return _hits(samples.where("image_path IS NULL AND label_exists"), "orphan_label_file")


def empty_labels(samples: DataFrame) -> DataFrame:
    return _hits(samples.where("label_exists AND n_boxes = 0 AND n_parse_errors = 0"), "empty_label_file")


def malformed_rows(parse_errors: DataFrame) -> DataFrame:
    return parse_errors.select(F.lit("malformed_label_row").alias("type"), "key", "line_no", F.col("reason").alias("note"))


def corrupt_images(images: DataFrame) -> DataFrame:
    return _hits(images.where("image_error IS NOT NULL"), "corrupt_image")


def rotated_images(images: DataFrame) -> DataFrame:
    return _hits(images.where("exif_orientation BETWEEN 2 AND 8"), "exif_orientation")


def located_images(images: DataFrame) -> DataFrame:
    return _hits(images.where("has_gps"), "gps_metadata")
