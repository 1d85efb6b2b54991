"""Content fingerprints: manifests, their digest, and their differences."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line(path: Column, sha1: Column) -> Column:
    return F.concat(path, F.lit("\0"), sha1, F.lit("\n"))


def digest(manifest: DataFrame) -> str:
    """SHA-256 over the lines of all files in path order, taken while rows stream to the driver one partition at a time."""
    h = hashlib.sha256()
    for row in manifest.select("path", line(F.col("path"), F.col("sha1")).alias("x")).orderBy("path").toLocalIterator():
        h.update(row["x"].encode())
    return h.hexdigest()


def bucket_digests(manifest: DataFrame, digits: int = 3) -> DataFrame:
    """(bucket, n, digest): SHA-256 of each bucket's lines in path order; a fixed number of buckets.

    For sizes at which a single ordered pass is too slow: buckets are hashed in parallel.
    """
    bucket = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, digits)
    rows = manifest.select(bucket.alias("bucket"), "path", line(F.col("path"), F.col("sha1")).alias("x"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "x"))), lambda s: s["x"]), "")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(ordered, 256).alias("digest"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of files added, removed or modified."""
    a, b = before.select("path", F.col("sha1").alias("was")), after.select("path", F.col("sha1").alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL")
