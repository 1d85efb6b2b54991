"""COCO JSON datasets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import geometry as G
from . import files

SCHEMA = """images array<struct<id:bigint,file_name:string,width:int,height:int>>,
    annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"""


def discover(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(split, path) of the annotation files: in split folders first, then annotations/, then the root."""
    base = files.plain_path(root).rstrip("/") + "/"
    names = [(p.removeprefix(base), p) for p, _ in files.list_files(spark, root) if p.endswith(".json")]
    split = [(r.split("/")[0], p) for r, p in names if re.fullmatch(r"[^/]+/_annotations\.coco\.json|(?!annotations/)[^/]+/annotations\.json", r)]
    if split:
        return split
    whole = [(r[len("annotations/instances_") : -5], p) for r, p in names if re.fullmatch(r"annotations/instances_[^/]+\.json", r)]
    if whole:
        return whole
    other = [(r[len("annotations/") : -5], p) for r, p in names if re.fullmatch(r"annotations/[^/]+\.json", r)]
    return other or [("train", p) for r, p in names if re.fullmatch(r"[^/]*\.coco\.json|instances_[^/]*\.json", r)]


def class_map(categories: DataFrame, used: DataFrame) -> DataFrame:
    """(category_id, cls): declared ids by their order, then undeclared ones by theirs.

    Categories are as few as class names, so one window over them is small.
    """
    declared = categories.select(F.col("id").alias("category_id")).distinct().withColumn("declared", F.lit(0))
    ids = used.select("category_id").where("category_id IS NOT NULL").distinct().join(declared, "category_id", "full_outer").withColumn("declared", F.coalesce("declared", F.lit(1)))
    return ids.select("category_id", (F.row_number().over(Window.orderBy("declared", "category_id")) - 1).cast("int").alias("cls"))


def picture_paths(spark: SparkSession, root: str, images: DataFrame) -> DataFrame:
    """(key, image_path) of the image files: where the entry says, else by their name, in a folder of the split first.

    Where no image file is there at all, the data is annotations alone and the entry's own words stand.
    """
    pictures = [(p, n) for p, n in files.list_files(spark, root) if p.rsplit(".", 1)[-1].lower() in files.IMAGE_SUFFIXES]
    if not pictures:
        return images.select("key", F.col("file_name").alias("image_path"))
    there = files.file_table(spark, pictures).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    both = images.select("key", "split", "file", "file_name").join(there, "file")
    apart = F.struct((~F.col("path").endswith(F.concat(F.lit("/"), "split", F.lit("/"), "file_name"))).alias("a"), (~F.col("path").contains(F.concat(F.lit("/"), "split", F.lit("/")))).alias("b"), (~F.col("path").endswith(F.concat(F.lit("/"), "file_name"))).alias("c"), "path")
    return both.groupBy("key").agg(F.min_by("path", apart).alias("image_path"))


def read(spark: SparkSession, root: str) -> model.Tables:
    """Images, boxes and names; annotations of unknown images and boxes without four numbers are dropped."""
    found = [(split, files.visible(spark, p)) for split, p in discover(spark, root)]
    splits = spark.createDataFrame(found, "split string, path string")
    docs = spark.read.schema(SCHEMA).option("multiLine", "true").json([p for _, p in found]).withColumn("path", files.plain(F.col("_metadata.file_path"))).join(F.broadcast(splits), "path")  # one row a file
    images = docs.select("split", F.inline("images")).withColumn("file", F.regexp_extract("file_name", "([^/]*)$", 1))
    images = images.withColumns({"stem": files.stem(F.col("file"))}).withColumn("key", F.concat_ws("/", "split", "stem"))
    notes = docs.select("split", F.inline("annotations")).withColumnRenamed("id", "annotation_id")
    cats = docs.select("path", F.inline("categories")).groupBy("id").agg(F.min_by("name", F.struct("path", "name")).alias("name"))
    mapped = class_map(cats, notes)
    boxes = notes.where("size(bbox) = 4").join(images.select("split", F.col("id").alias("image_id"), "key", "stem", "width", "height"), ["split", "image_id"]).join(mapped, "category_id")
    x, y, w, h = (F.get("bbox", i) for i in range(4))
    wide, high = F.col("width").cast("double"), F.col("height").cast("double")
    sized = (wide > 0) & (high > 0)
    x1, x2, y1, y2 = G.snap(x, wide), G.snap(x + w, wide), G.snap(y, high), G.snap(y + h, high)
    unit = {"xc": ((x1 + x2) / 2 / wide, x + w / 2), "yc": ((y1 + y2) / 2 / high, y + h / 2), "w": ((x2 - x1) / wide, w), "h": ((y2 - y1) / high, h)}
    values = [F.when(sized, a).otherwise(b).alias(k) for k, (a, b) in unit.items()]
    line = F.row_number().over(Window.partitionBy("key").orderBy("annotation_id", "category_id"))
    boxes = boxes.select("key", "split", "stem", line.alias("line_no"), "cls", *values, F.to_json("bbox").alias("raw"), F.lit(None).cast(model.POLYGON).alias("polygon"), F.lit(None).cast(model.KEYPOINTS).alias("keypoints"))
    n = boxes.groupBy("key").agg(F.count("*").cast("int").alias("n"))
    samples = images.join(n, "key", "left").join(picture_paths(spark, root, images), "key", "left").select("split", "stem", "key", "image_path", F.lit(None).cast("string").alias("label_path"), F.lit(True).alias("label_exists"), F.coalesce("n", F.lit(0)).alias("n_boxes"), F.lit(0).alias("n_parse_errors"))
    taxonomy = mapped.join(cats, mapped["category_id"] == cats["id"]).select("cls", "name")
    names = [r["name"] for r in taxonomy.orderBy("cls").collect()]
    errors = spark.createDataFrame([], model.PARSE_ERRORS)
    return model.Tables(model.Meta(root=root, names=names, task_source="coco"), samples, boxes, errors, images=images.select("key", "width", "height"), taxonomy=taxonomy)
