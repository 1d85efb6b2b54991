"""Listing files by the file system that Spark itself uses, empty ones included."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

FILES = "path string, size bigint"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def plain(path: Column) -> Column:
    """One spelling of local paths: ``file:/x`` and ``file:///x`` are ``/x``."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain_path(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, root: str, below: str = "", recursive: bool = True) -> list[tuple[str, int]]:
    """(path, size) of the files under ``root/below``, sorted; none if it isn't there.  Metadata only."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/{below}" if below else root)
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        s = it.next()
        out.append((plain_path(s.getPath().toString()), s.getLen()))
    return sorted(out)


def file_table(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(files, FILES)


def visible(spark: SparkSession, path: str) -> str:
    """A path that Spark's readers see: a name that begins with ``_`` or ``.`` is hidden from them, so its file is copied to the shared folder."""
    name = path.rsplit("/", 1)[-1]
    if name[0] not in "_.":
        return path
    base = shared_folder(spark)
    jvm = spark._jvm
    (fs, p), (to_fs, to) = _fs(spark, path), _fs(spark, f"{base}/copies/{uuid.uuid4().hex}/{name.lstrip('_.')}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, to, False, spark._jsc.hadoopConfiguration())
    return plain_path(to_fs.makeQualified(to).toString())


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small description file, or None."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def content_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size) of what a fingerprint covers: no hidden part, no card file."""
    skip = ("health.json", "manifest.tsv", "DATASET_HEALTH.md")
    base = plain_path(root).rstrip("/") + "/"
    rows = [(p.removeprefix(base), n) for p, n in list_files(spark, root)]
    return file_table(spark, [(p, n) for p, n in rows if not any(x.startswith(".") for x in p.split("/")) and p not in skip])


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha1) of the content files; contents are hashed where they are read, empty files too."""
    base = plain_path(root).rstrip("/") + "/"
    listed = content_files(spark, root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hashed = read.select(F.regexp_replace(plain(F.col("path")), "^" + "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in base), "").alias("path"), F.sha1("content").alias("sha1"))
    empty = F.sha1(F.lit(b""))
    return listed.join(hashed, "path", "left").select("path", "size", F.coalesce("sha1", F.when(F.col("size") == 0, empty)).alias("sha1"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="path string, size bigint, sha1 string").where("path IS NOT NULL")
