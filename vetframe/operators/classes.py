"""Class counts, balance between splits, and what hides in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import names

TRAIN_LEAST, VAL_LEAST, RATIO = 10, 3, 50
SPLIT_TOTAL, SPLIT_LOW, SPLIT_HIGH = 20, 0.05, 0.50
SKEW_ROWS, SKEW_MODAL, SKEW_BASE = 20, 0.90, 0.60
TEMPLATE_KEYS, TEMPLATES = 5, 10


def summary(samples: DataFrame) -> DataFrame:
    """Images, label files and boxes of each split."""
    return samples.groupBy("split").agg(F.count("image_path").alias("images"), F.count_if("label_exists").alias("label_files"), F.sum("n_boxes").cast("long").alias("boxes"))


def distribution(boxes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(split, cls, name, n): every class in every split, 0 included, and ids without a name."""
    counts = boxes.groupBy("split", "cls").agg(F.count("*").alias("n"))  # splits x classes rows
    grid = counts.select("split").distinct().crossJoin(taxonomy.select("cls"))  # both sides are names, not rows
    filled = grid.join(counts, ["split", "cls"], "full_outer").join(taxonomy, "cls", "left")
    unnamed = F.concat(F.lit("<id "), F.col("cls").cast("string"), F.lit(" not in data.yaml>"))
    return filled.select("split", "cls", F.coalesce("name", unnamed).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


def _first_split(boxes_by_split: DataFrame, order: tuple[str, ...]) -> str | None:
    have = {r[0] for r in boxes_by_split.where(F.col("split").isin(*order)).select("split").distinct().collect()}  # names in ``order`` alone
    return next((s for s in order if s in have), None)


def imbalance(boxes: DataFrame, nc: int) -> DataFrame:
    """(cls, n_train, n_val, reason flags) of classes that training would hardly see.

    The train and val splits are the first names of the priority lists that hold boxes.
    """
    counts = boxes.groupBy("split", "cls").agg(F.count("*").alias("n"))
    train, val = _first_split(counts, vocab.TRAIN_NAMES), _first_split(counts, vocab.VAL_NAMES)
    per = counts.groupBy("cls").agg(*(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(a) for a, s in (("n_train", train or ""), ("n_val", val or ""))))
    busiest = per.agg(F.coalesce(F.max("n_train"), F.lit(0)).alias("busiest"))
    if nc:
        ids = boxes.sparkSession.range(nc).select(F.col("id").cast("int").alias("cls"))
        per = ids.join(per, "cls", "left").na.fill(0, ["n_train", "n_val"])
    per = per.join(F.broadcast(busiest), how="cross")  # one row
    n = F.col("n_train")
    flags = {"absent": n == 0, "few": n < TRAIN_LEAST, "rare": (n > 0) & (F.col("busiest") / F.greatest(n, F.lit(1)) >= RATIO), "unmeasured": (F.col("n_val") < VAL_LEAST) & F.lit(val is not None)}
    any_ = flags["absent"] | flags["few"] | flags["rare"] | flags["unmeasured"]
    return per.where(any_).select("cls", "n_train", "n_val", *(v.alias(k) for k, v in flags.items()))


def by_role(boxes: DataFrame) -> DataFrame:
    """(cls, n_train, n_val): all splits of a role together."""
    role = names.role(F.col("split"))
    return boxes.groupBy("cls").agg(F.count_if(role == "train").alias("n_train"), F.count_if(role == "val").alias("n_val"))


def absent_from_val(boxes: DataFrame) -> DataFrame:
    """Classes that are trained but never validated; nothing if no val split has a box."""
    per = by_role(boxes)
    any_val = per.agg(F.sum("n_val").alias("v")).where("v > 0").select()
    return per.where("n_train > 0 AND n_val = 0").join(F.broadcast(any_val), how="cross").select("cls", "n_train")


def split_ratio(samples: DataFrame) -> DataFrame:
    """One row (n_train, n_val) if val holds under 5 % or over 50 % of 20 images or more."""
    role = names.role(F.col("split"))
    n = samples.where("image_path IS NOT NULL").agg(F.count_if(role == "train").alias("n_train"), F.count_if(role == "val").alias("n_val"))
    share = F.col("n_val") / (F.col("n_train") + F.col("n_val"))
    return n.where((F.col("n_train") + F.col("n_val") >= SPLIT_TOTAL) & ((F.col("n_val") == 0) | (share < SPLIT_LOW) | (share > SPLIT_HIGH)))


def representation_skew(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(cls, bucket, n, in_bucket): classes nearly all of whose boxes come from images of one size that is not the usual one.

    The modal size of a class is the one with most boxes, then the smaller name.
    """
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    sized = images.where("width > 0 AND height > 0").select("key", size.alias("bucket"))
    labelled = sized.join(boxes.select("key").distinct(), "key", "left_semi")
    base = labelled.groupBy("bucket").agg(F.count("*").alias("images"))
    total = base.agg(F.sum("images").alias("all_images"), F.count("*").alias("buckets")).where("all_images >= 20 AND buckets >= 2")
    per = boxes.join(labelled, "key").groupBy("cls", "bucket").agg(F.count("*").alias("in_bucket"))
    best = per.groupBy("cls").agg(F.sum("in_bucket").alias("n"), F.max("in_bucket").alias("in_bucket"), F.min_by("bucket", F.struct(-F.col("in_bucket"), F.col("bucket"))).alias("bucket"))
    skewed = best.join(base, "bucket").join(F.broadcast(total), how="cross")
    keep = (F.col("n") >= SKEW_ROWS) & (F.col("in_bucket") / F.col("n") >= SKEW_MODAL) & (F.col("images") / F.col("all_images") <= SKEW_BASE)
    return skewed.where(keep).select("cls", "bucket", "n", "in_bucket")


def templates(boxes: DataFrame, signature: list[str]) -> DataFrame:
    """(*signature, n_keys, n_boxes) of boxes that recur in five files or more."""
    per_file = boxes.groupBy(*signature, "key").agg(F.count("*").alias("n"))
    return per_file.groupBy(*signature).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_boxes")).where(F.col("n_keys") >= TEMPLATE_KEYS)


def template_hits(boxes: DataFrame, signature: list[str]) -> DataFrame:
    """Rows of the ten templates that most files hold."""
    top = templates(boxes, signature).orderBy(F.desc("n_keys"), *signature).limit(TEMPLATES)
    return boxes.join(F.broadcast(top.select(*signature)), signature, "left_semi")


def modal(counts: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """The most frequent ``value`` of each ``by``; ties go to the smaller value."""
    w = Window.partitionBy(by).orderBy(F.desc(n), value)
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
