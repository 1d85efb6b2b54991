"""Canonical tables written as files: YOLO text, manifests, fixed copies, splits and merges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Tables
from ..sources.files import plain_path


def yolo_row(shapes: bool = False) -> Column:
    """A label row with ten decimals: fewer would move corners beyond the frame when they are computed back."""
    number = lambda c: F.format_string("%.10f", c)
    box = F.concat_ws(" ", F.col("cls").cast("string"), *(number(F.col(c)) for c in ("xc", "yc", "w", "h")))
    if not shapes:
        return box
    polygon = F.array_join(F.transform("polygon", lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), " ")
    points = F.array_join(F.transform("keypoints", lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]), F.format_string("%.0f", p["v"]))), " ")
    return F.when(F.col("polygon").isNotNull(), F.concat_ws(" ", F.col("cls").cast("string"), polygon)).when(F.col("keypoints").isNotNull(), F.concat_ws(" ", box, points)).otherwise(box)


def label_texts(boxes: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(key, content): one label file a sample, in line order; samples without boxes have an empty one."""
    shapes = "polygon" in boxes.columns
    rows = boxes.select("key", F.struct("line_no", yolo_row(shapes).alias("row")).alias("r"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "\n"), F.lit("\n"))
    files = rows.groupBy("key").agg(text.alias("content"))
    if samples is None:
        return files
    return samples.where("label_exists").select("key").join(files, "key", "left").withColumn("content", F.coalesce("content", F.lit("")))


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) below ``root`` with the file system that Spark uses; partitions stream through the driver's JVM one at a time."""
    spark = files.sparkSession
    jvm, n = spark._jvm, 0
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # plain files, that other tools may edit
    for r in files.select("path", "content").toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{r['path']}"), True)
        data = r["content"]
        out.write(bytes(data) if isinstance(data, (bytes, bytearray)) else data.encode())
        out.close()
        n += 1
    return n


def copy_images(samples: DataFrame, root: str, stripped: DataFrame | None = None) -> int:
    """Copy the images of ``samples`` to ``root``/images/<key>, each by the task that has its row; how many there were.

    Images with a key in ``stripped`` (key) lose their Exif segments.  A task that
    runs again writes the same files again.
    """
    from ..functions import imagebytes

    rows = samples.where("image_path IS NOT NULL").select("key", "image_path")
    marked = rows.withColumn("strip", F.lit(False)) if stripped is None else rows.join(stripped.select("key", F.lit(True).alias("strip")).distinct(), "key", "left")
    base = plain_path(root).rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            n = 0
            for r in f.itertuples():
                source, at = fs.FileSystem.from_uri(r.image_path)
                info = source.get_file_info(at)
                if info.type != fs.FileType.File:
                    continue
                with source.open_input_stream(at) as stream:
                    data = stream.read()
                name = r.image_path.rsplit("/", 1)[-1]
                suffix = name.rsplit(".", 1)[-1] if "." in name else "jpg"
                target, to = fs.FileSystem.from_uri(f"{base}/images/{r.key}.{suffix}")
                target.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(to) as stream:
                    stream.write(imagebytes.strip_exif(data) if r.strip is True and data[:2] == b"\xff\xd8" else data)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return marked.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_yolo(tables: Tables, root: str, images: bool = False, stripped: DataFrame | None = None) -> int:
    """Labels and the description file, and the images where asked for; the number of label and description files.

    At scale use ``write_parquet``: one small file an image suits no cluster.
    """
    import yaml

    spark = tables.boxes.sparkSession
    if images:
        copy_images(tables.samples, root, stripped)
    labels = label_texts(tables.boxes, tables.samples).select(F.concat(F.lit("labels/"), "key", F.lit(".txt")).alias("path"), "content")
    about = yaml.safe_dump({"names": list(tables.meta.names), "nc": tables.meta.nc, "task": tables.meta.task}, sort_keys=False)
    return write_files(labels.unionByName(spark.createDataFrame([("data.yaml", about)], "path string, content string")), root)


def write_parquet(tables: Tables, root: str) -> None:
    for name in ("samples", "boxes", "parse_errors", "images", "taxonomy"):
        table = getattr(tables, name)
        if table is not None:
            (table.write.mode("overwrite").partitionBy("split") if "split" in table.columns else table.write.mode("overwrite")).parquet(f"{root.rstrip('/')}/{name}")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One row a file, in path order: sorted ranges are written side by side."""
    manifest.select("path", "size", "sha1").orderBy("path").write.mode("overwrite").csv(path, sep="\t")


def strip_exif(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, content) of JPEG files without their Exif segments; tasks rewrite the bytes."""
    from ..functions import imagebytes

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [imagebytes.strip_exif(bytes(c)) for c in f["content"]]})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, "path string, content binary")
