"""YOLO text datasets: images/<split>/, labels/<split>/ and a description file."""

from __future__ import annotations

from dataclasses import replace

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from . import files, labelrows

DESCRIPTIONS = ("data.yaml", "dataset.yaml", "data.yml")
LICENSE_NAMES = frozenset(f"{n}{s}" for n in ("license", "licence", "copying") for s in ("", ".txt", ".md", ".rst")) | {"readme.license", "license-data", "data_license", "license.pdf", "license.html", "notice"}


def read_meta(spark: SparkSession, root: str) -> model.Meta:
    """Names, task and key points from the first description file; what is wrong with it becomes ``yaml_error``."""
    base = root.rstrip("/")
    meta = model.Meta(root=root, has_license=any(p.rsplit("/", 1)[-1].lower() in LICENSE_NAMES for p, _ in files.list_files(spark, root, recursive=False)))
    text = next((t for n in DESCRIPTIONS if (t := files.read_text(spark, f"{base}/{n}")) is not None), None)
    if text is None:
        return replace(meta, yaml_error="no description file")
    try:
        spec = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return replace(meta, yaml_error=f"invalid YAML: {str(e).splitlines()[0]}")
    spec = spec if isinstance(spec, dict) else {}
    names, error = spec.get("names"), None
    if isinstance(names, dict):
        try:
            names = [str(names[k]) for k in sorted(names, key=int)]
        except (TypeError, ValueError):
            names = None
    names = [str(n) for n in names] if isinstance(names, list) else []
    if not names:
        error = "no usable names"
    if "nc" in spec:
        try:
            if int(spec["nc"]) != len(names):
                error = f"nc is {spec['nc']}, but there are {len(names)} names"
        except (TypeError, ValueError):
            error = f"nc is no number: {spec['nc']!r}"
    meta = replace(meta, names=names, yaml_error=error)
    shape = spec.get("kpt_shape")
    if isinstance(shape, list) and shape:
        return replace(meta, task="pose", task_source="kpt_shape", n_kpt=int(shape[0]), kpt_dim=int(shape[1]) if len(shape) > 1 else 3)
    if spec.get("task") in ("detect", "segment", "pose"):
        return replace(meta, task=spec["task"], task_source="yaml")
    return meta


def infer_task(rows: DataFrame) -> str:
    """Segment if nine rows in ten of the first files have the width of a polygon, of five rows or more."""
    n = F.size(F.split("raw", r"\s+"))
    r = rows.agg(F.count("*").alias("n"), F.count_if((n >= 7) & ((n - 1) % 2 == 0)).alias("p")).first()
    return "segment" if r["n"] >= 5 and r["p"] >= 0.9 * r["n"] else "detect"


def _entries(spark: SparkSession, root: str, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    base = f"{files.plain_path(root).rstrip('/')}/{folder}/"
    found = [(p, n) for p, n in files.list_files(spark, root, folder) if p.rsplit(".", 1)[-1].lower() in suffixes and p.removeprefix(base).count("/") == 1]
    df = files.file_table(spark, found)
    split = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return df.select(split.alias("split"), files.stem(F.col("path")).alias("stem"), "path", "size")


def read(spark: SparkSession, root: str, task: str | None = None) -> model.Tables:
    """Samples, boxes and parse errors; files are listed once and read by tasks.

    Of images that share a stem the last in order counts; label files of zero
    bytes are samples without boxes.
    """
    meta = read_meta(spark, root)
    images = _entries(spark, root, "images", files.IMAGE_SUFFIXES).groupBy("split", "stem").agg(F.max("path").alias("image_path"))
    labels = _entries(spark, root, "labels", ("txt",))
    key = F.concat_ws("/", "split", "stem")
    paths = labels.where("size > 0").select(key.alias("key"), "path")
    if paths.limit(1).count():
        text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(f"{root.rstrip('/')}/labels", wholetext=True)
        content = text.select(files.plain(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
        read_ = content.join(paths, "path").select("key", "content")
    else:
        read_ = spark.createDataFrame([], "key string, content string")
    rows = labelrows.lines(read_)
    if task:
        meta = replace(meta, task=task, task_source="argument")
    elif meta.task_source == "default":
        first = labels.orderBy("path").limit(40).select(key.alias("key"))
        meta = replace(meta, task=infer_task(rows.join(F.broadcast(first), "key", "left_semi")), task_source="inferred")  # 40 keys
    boxes, errors = labelrows.parse(rows, meta.task, meta.n_kpt, meta.kpt_dim)
    counts = boxes.groupBy("key").agg(F.count("*").cast("int").alias("nb")).join(errors.groupBy("key").agg(F.count("*").cast("int").alias("ne")), "key", "full_outer")
    both = images.join(labels.select("split", "stem", F.col("path").alias("label_path")), ["split", "stem"], "full_outer").withColumn("key", key)
    samples = both.join(counts, "key", "left").select("split", "stem", "key", "image_path", "label_path", F.col("label_path").isNotNull().alias("label_exists"), F.coalesce("nb", F.lit(0)).alias("n_boxes"), F.coalesce("ne", F.lit(0)).alias("n_parse_errors"))
    named = boxes.withColumns({"split": F.regexp_extract("key", "^([^/]*)/", 1), "stem": F.regexp_extract("key", "/(.*)$", 1)})
    taxonomy = spark.createDataFrame(list(enumerate(meta.names)), model.TAXONOMY)
    return model.Tables(meta, samples, named.select("key", "split", "stem", "line_no", "cls", "xc", "yc", "w", "h", "raw", "polygon", "keypoints"), errors, taxonomy=taxonomy)
