"""Merging datasets by class name, and what stands in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def merged_taxonomy(taxonomies: DataFrame) -> DataFrame:
    """(name, new_id) over (source, cls, name): ids by the order of the distinct names.

    Classes are few: their number is that of label names, not of rows.
    """
    from pyspark.sql import Window

    return taxonomies.select("name").distinct().withColumn("new_id", F.row_number().over(Window.orderBy("name")) - 1)


def id_collisions(taxonomies: DataFrame) -> DataFrame:
    """(cls, n_names): ids that mean more than one name."""
    return taxonomies.groupBy("cls").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")


def name_variants(taxonomies: DataFrame) -> DataFrame:
    """(norm, n_names): names that differ only in spelling; a merge needs a decision about them."""
    return taxonomies.select(names.normalised(F.col("name")).alias("norm"), "name").groupBy("norm").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")


def remap(taxonomies: DataFrame) -> DataFrame:
    """(source, cls, new_id)."""
    return taxonomies.join(merged_taxonomy(taxonomies), "name").select("source", "cls", "new_id")


def filename_collisions(samples: DataFrame) -> DataFrame:
    """(stem, n_sources) of stems that several sources use."""
    return samples.groupBy("stem").agg(F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


def merge_boxes(boxes: DataFrame, taxonomies: DataFrame, collisions: DataFrame) -> DataFrame:
    """Boxes (source, stem, cls, ...) with merged class ids; a stem that collides is prefixed by its source."""
    mapped = boxes.join(remap(taxonomies), ["source", "cls"]).drop("cls").withColumnRenamed("new_id", "cls")
    marked = mapped.join(collisions.select("stem", F.lit(True).alias("collides")), "stem", "left")
    stem = F.when(F.col("collides"), F.concat(F.lit("s"), F.col("source").cast("string"), F.lit("_"), F.col("stem"))).otherwise(F.col("stem"))
    return marked.withColumn("stem", stem).drop("collides")


def needs_decision(taxonomies: DataFrame) -> bool:
    return name_variants(taxonomies).limit(1).count() > 0
