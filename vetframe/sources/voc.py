"""Pascal VOC datasets: one XML file an image."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import geometry as G
from . import files

SCHEMA = """filename string, size struct<width:string,height:string>, object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>, _corrupt_record string"""
FOLDERS = ("Annotations", "annotations")


def class_map(names: DataFrame) -> DataFrame:
    """(name, cls): ids by the order of the names, which are few."""
    return names.select("name").where("name IS NOT NULL AND name <> ''").distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("cls"))


def annotation_dir(spark: SparkSession, root: str) -> str | None:
    base = root.rstrip("/")
    for d in FOLDERS:
        if any(p.endswith(".xml") for p, _ in files.list_files(spark, root, d)):
            return f"{base}/{d}"
    return base if any(p.endswith(".xml") for p, _ in files.list_files(spark, root, recursive=False)) else None


def split_lists(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem) of the lists whose name has no underscore."""
    found = [p for p, _ in files.list_files(spark, root, "ImageSets/Main") if re.fullmatch(r"[^_/]+\.txt", p.rsplit("/", 1)[-1])]
    if not found:
        return spark.createDataFrame([], "split string, stem string")
    lines = spark.read.text(found).select(files.stem(files.plain(F.col("_metadata.file_path"))).alias("split"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("stem"))
    return lines.where("stem <> ''").distinct()


def read(spark: SparkSession, root: str) -> model.Tables:
    """Corners lose one pixel, as they count from 1; objects without a name or a box are skipped; broken XML is a parse error."""
    docs = spark.read.format("xml").option("rowTag", "annotation").option("mode", "PERMISSIVE").schema(SCHEMA).load(annotation_dir(spark, root))
    docs = docs.withColumn("stem", files.stem(files.plain(F.col("_metadata.file_path"))))
    lists = split_lists(spark, root)
    if lists.limit(1).count():
        placed = lists.join(docs, "stem", "left")
    else:
        placed = docs.withColumn("split", F.lit("train"))
    placed = placed.withColumn("key", F.concat_ws("/", "split", "stem"))
    wide, high = F.col("size.width").try_cast("double"), F.col("size.height").try_cast("double")
    objects = placed.select("key", "split", "stem", wide.alias("wide"), high.alias("high"), F.posexplode("object").alias("pos", "o"))
    corner = {c: F.col(f"o.bndbox.{c}").try_cast("double") - 1 for c in ("xmin", "ymin", "xmax", "ymax")}
    named = objects.select("key", "split", "stem", "wide", "high", "pos", F.trim("o.name").alias("name"), *(v.alias(k) for k, v in corner.items()))
    named = named.where("name <> '' AND xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL")
    mapped = class_map(named)
    sized = (F.col("wide") > 0) & (F.col("high") > 0)
    x1, x2, y1, y2 = (F.when(sized, G.snap(F.col(c), F.col(e)) / F.col(e)).otherwise(F.col(c)) for c, e in (("xmin", "wide"), ("xmax", "wide"), ("ymin", "high"), ("ymax", "high")))
    line = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    boxes = named.join(mapped, "name").select(
        "key", "split", "stem", line.alias("line_no"), "cls", ((x1 + x2) / 2).alias("xc"), ((y1 + y2) / 2).alias("yc"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), "name",
        F.lit(None).cast(model.POLYGON).alias("polygon"), F.lit(None).cast(model.KEYPOINTS).alias("keypoints"),
    ).withColumnRenamed("name", "raw")
    # Spark refuses a query of the corrupt record alone, so another column stands beside it
    errors = placed.where("length(concat(coalesce(filename, ''), _corrupt_record)) > 0").select("key", F.lit(1).alias("line_no"), F.substring("_corrupt_record", 1, 200).alias("raw"), F.lit("malformed XML").alias("reason"))
    pictures = [(p, n) for d in ("JPEGImages", "images", "Images", "JPEGimages") for p, n in files.list_files(spark, root, d) if p.rsplit(".", 1)[-1].lower() in files.IMAGE_SUFFIXES]
    images = files.file_table(spark, pictures).groupBy(files.stem(F.col("path")).alias("stem")).agg(F.max("path").alias("image_path"))
    n = boxes.groupBy("key").agg(F.count("*").cast("int").alias("n"))
    ne = errors.groupBy("key").agg(F.count("*").cast("int").alias("ne"))
    samples = placed.select("split", "stem", "key", (F.col("filename").isNotNull() | F.col("size").isNotNull() | F.col("object").isNotNull() | F.col("_corrupt_record").isNotNull()).alias("label_exists"))
    samples = samples.join(images, "stem", "left").join(n, "key", "left").join(ne, "key", "left")
    samples = samples.select("split", "stem", "key", "image_path", F.lit(None).cast("string").alias("label_path"), "label_exists", F.coalesce("n", F.lit(0)).alias("n_boxes"), F.coalesce("ne", F.lit(0)).alias("n_parse_errors"))
    names = [r["name"] for r in mapped.orderBy("cls").collect()]
    sizes = placed.select("key", wide.cast("int").alias("width"), high.cast("int").alias("height"))
    return model.Tables(model.Meta(root=root, names=names, task_source="voc"), samples, boxes, errors, images=sizes, taxonomy=mapped.select("cls", "name"))
