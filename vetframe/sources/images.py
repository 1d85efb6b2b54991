"""Image files as rows: size, integrity, hashes and metadata, read once by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imagebytes
from .files import IMAGE_SUFFIXES, plain

cloudpickle.register_pickle_by_value(imagebytes)
PROBED = "key string, path string, size bigint, width int, height int, image_error string, hash bigint, sha1 string, exif_orientation int, has_gps boolean"


#: Names that the scan of images reads, in any case.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in IMAGE_SUFFIXES) + "}"


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """What each image file below ``folder`` holds: contents are read and left behind where the files are scanned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                data = bytes(r.content) if r.content is not None else b""
                error = imagebytes.check(data)
                try:
                    w, h = imagebytes.size(data)
                except ValueError:
                    w = h = None
                turn, gps = imagebytes.exif(data)
                out.append((r.path, len(data), w, h, error, None if error else imagebytes.dhash(data), None if error else r.digest, turn, gps))
            frame = pd.DataFrame(out, columns=["path", "size", "width", "height", "image_error", "hash", "sha1", "exif_orientation", "has_gps"])
            yield frame.astype({"width": "Int32", "height": "Int32", "hash": "Int64", "exif_orientation": "Int32"})

    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(folder)
    return content.select(plain(F.col("path")).alias("path"), "content", F.sha1("content").alias("digest")).mapInPandas(run, PROBED.replace("key string, ", ""))


def probe(spark: SparkSession, samples: DataFrame, root: str, declared: DataFrame | None = None) -> DataFrame:
    """One row for each sample with an image.  Files that cannot be decoded have no hash and no digest.

    Sizes that a source declares (key, width, height) go before those of the file.
    """
    wanted = samples.where("image_path IS NOT NULL").select("key", F.col("image_path").alias("path"))
    found = wanted.join(scanned(spark, root), "path", "left").withColumn("image_error", F.when(F.col("size").isNull(), "no file").otherwise(F.col("image_error")))
    if declared is not None:
        said = declared.select("key", F.col("width").alias("w"), F.col("height").alias("h"))
        found = found.join(said, "key", "left").withColumns({"width": F.coalesce("w", "width"), "height": F.coalesce("h", "height")})
    return found.select(*(c.split(" ")[0] for c in PROBED.split(", ")))
