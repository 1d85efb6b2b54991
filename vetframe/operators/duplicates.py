"""Near-duplicate images: a Hamming join that loses no pair, and what follows from its links.

Two hashes within distance d agree in at least m - d of m bands, so an equality
join on each choice of m - d bands finds every pair.  m follows the number of
hashes: with one band of d + 1 the pairs to compare grow with its square.  Equal
hashes are joined as one row and expanded only where a pair listing is asked for;
a pair is taken in the first choice in which it agrees, so no distinct is needed.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import bits as B
from ..session import shared_folder

DISTANCE = 5


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the folder all executors share."""
    base = shared_folder(spark)
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def band_count(n: int, distance: int = DISTANCE, bits: int = 64) -> int:
    """Bands for ``n`` distinct hashes: each more of them means more rows to join and fewer pairs to compare."""

    def work(bands: int) -> float:
        return sum(n + n * n / 16 / 2 ** sum(kept) for kept in combinations(B.widths(bands, bits), bands - distance))

    return min(range(distance + 1, max(distance + 1, min(bits, distance + 5)) + 1), key=work)


def hash_links(hashes: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(a, b, d) of all pairs a < b of distinct values of ``hash`` within ``distance``; the values are written first, and counted."""
    if bands is not None and bands <= distance:
        raise ValueError(f"{bands} bands lose pairs at distance {distance}")
    distinct = shared_table(hashes.sparkSession, hashes.select("hash").where("hash IS NOT NULL").distinct(), "hashes")
    bands = bands or band_count(distinct.count(), distance, bits)
    masks = [((1 << w) - 1) << s for s, w in B.masks(bands, bits)]
    signed = lambda mask: F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")
    choices = [(sum(1 << i for i in c), sum(masks[i] for i in c)) for c in combinations(range(bands), bands - distance)]
    cut = F.array(*(F.struct(F.lit(c).cast("long").alias("choice"), F.col("hash").bitwiseAND(signed(mask)).alias("value")) for c, mask in choices))
    banded = distinct.select("hash", F.inline(cut))
    a, b = banded.select(F.col("hash").alias("a"), "choice", "value"), banded.select(F.col("hash").alias("b"), "choice", "value")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agree = F.lit(0).cast("long")
    for i, mask in enumerate(masks):
        agree = agree.bitwiseOR(F.when(differ.bitwiseAND(signed(mask)) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    more = agree.bitwiseXOR(F.col("choice"))  # other bands that agree; in the first choice all of them come later
    first = (more == 0) | (more.bitwiseAND(-more) > F.col("choice"))
    return a.join(b, ["choice", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & first).select("a", "b", F.bit_count(differ).alias("d"))


def hamming_pairs(images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(l, r, d) of image keys whose hashes lie within ``distance``; l < r, every pair listed."""
    keyed = images.where("hash IS NOT NULL").select("key", "hash")
    links = hash_links(keyed, distance, bands, bits)
    left, right = keyed.select(F.col("key").alias("k1"), F.col("hash").alias("a")), keyed.select(F.col("key").alias("k2"), F.col("hash").alias("b"))
    near = links.join(left, "a").join(right, "b").select(F.least("k1", "k2").alias("l"), F.greatest("k1", "k2").alias("r"), "d")
    same = left.join(right, F.col("a") == F.col("b")).where("k1 < k2").select(F.col("k1").alias("l"), F.col("k2").alias("r"), F.lit(0).alias("d"))
    return near.unionByName(same)


def all_pairs(images: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The same by comparing everything with everything; for tests."""
    a, b = images.select(F.col("key").alias("l"), F.col("hash").alias("a")), images.select(F.col("key").alias("r"), F.col("hash").alias("b"))
    d = B.hamming(F.col("a"), F.col("b"))
    return a.crossJoin(b).where((F.col("l") < F.col("r")) & (d <= distance)).select("l", "r", d.alias("d"))


def exact_groups(images: DataFrame, digest: str = "sha1") -> DataFrame:
    """(digest, n, first_key) of contents that occur more than once: groups, not pairs."""
    return images.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")


def _labelled(images: DataFrame, distance: int, bands: int | None, bits: int) -> DataFrame:
    """(a, b): each distinct hash with every other near it; links are found once and told in both directions."""
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return hash_links(images, distance, bands, bits).select(F.inline(both))


def _hashed(images: DataFrame, *columns: str) -> DataFrame:
    """The images that have a hash, as a table: what is joined to its own links is hashed once."""
    return shared_table(images.sparkSession, images.where("hash IS NOT NULL").select(*columns, "hash"), "images")


def leakage(images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(key) of val images that have a near copy in train; split names are compared as they are written.

    Hashes are reduced to one row a role first, so copies never multiply.
    """
    role = F.when(F.col("split").isin(*vocab.TRAIN_NAMES), "train").when(F.col("split").isin(*vocab.VAL_NAMES), "val")
    seen = _hashed(images, "key", "split").withColumn("role", role)
    near = _labelled(seen, distance, bands, bits)
    trained = seen.where("role = 'train'").select("hash").distinct()
    reach = near.join(trained, F.col("a") == F.col("hash"), "left_semi").select(F.col("b").alias("hash")).union(trained).distinct()
    return seen.where("role = 'val'").join(reach, "hash", "left_semi").select("key")


def leaking_pairs(images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(key, train_key, d): each leaked val image with its nearest train image, the first of equals.

    One train image stands for all that share its hash, so copies never multiply.
    """
    role = F.when(F.col("split").isin(*vocab.TRAIN_NAMES), "train").when(F.col("split").isin(*vocab.VAL_NAMES), "val")
    seen = _hashed(images, "key", "split").withColumn("role", role)
    trained = seen.where("role = 'train'").groupBy("hash").agg(F.min("key").alias("train_key"))
    links = hash_links(seen, distance, bands, bits)
    both = links.select(F.inline(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))))
    near = both.join(trained.withColumnRenamed("hash", "a"), "a").select(F.col("b").alias("hash"), "train_key", "d").union(trained.select("hash", "train_key", F.lit(0).alias("d")))
    nearest = near.groupBy("hash").agg(F.min(F.struct("d", "train_key")).alias("n")).select("hash", "n.train_key", "n.d")
    return seen.where("role = 'val'").join(nearest, "hash").select("key", "train_key", "d")


def near_within_split(images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(key, split) of images that have a near copy in their own split."""
    seen = _hashed(images, "key", "split")
    per = seen.groupBy("split", "hash").agg(F.count("*").alias("n"))
    near = _labelled(seen, distance, bands, bits)
    other = per.select(F.col("split").alias("s2"), F.col("hash").alias("b"))
    linked = near.join(per.select("split", F.col("hash").alias("a")), "a").join(other, "b").where("split = s2").select("split", F.col("a").alias("hash"))
    hit = linked.union(per.where("n > 1").select("split", "hash")).distinct()
    return seen.join(hit, ["split", "hash"], "left_semi").select("key", "split")


def across_sources(images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(key, source, identical) of images with a near copy in another source; identical if a copy is exact."""
    seen = _hashed(images, "key", "source")
    per = seen.select("source", "hash").distinct()
    links = _labelled(seen, distance, bands, bits)
    same = per.select(F.col("hash").alias("a"), F.col("hash").alias("b")).distinct()
    near = links.union(same)
    joined = near.join(per.select("source", F.col("hash").alias("a")), "a").join(per.select(F.col("source").alias("s2"), F.col("hash").alias("b")), "b").where("source <> s2")
    hit = joined.groupBy("source", F.col("a").alias("hash")).agg(F.max(F.col("a") == F.col("b")).alias("identical"))
    return seen.join(hit, ["source", "hash"]).select("key", "source", "identical")


def components(spark: SparkSession, images: DataFrame, distance: int = DISTANCE, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(key, group_key): near-duplicate groups over all splits; images without a hash are alone.

    Labels fall along links of distinct hashes, then jump; each round is a table in the shared folder.
    """
    images = shared_table(spark, images.select("key", "hash"), "images")
    both = shared_table(spark, _labelled(images, distance, bands, bits), "links")
    labels = shared_table(spark, both.groupBy(F.col("a").alias("hash")).agg(F.min("b").alias("m")).select("hash", F.least("hash", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("hash")).groupBy(F.col("a").alias("hash")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "hash").select("hash", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("hash").alias("label"), F.col("label").alias("next"))
        new = shared_table(spark, lower.join(jump, "label", "left").select("hash", "was", F.least("label", "next").alias("label")), "labels")
        labels, moved = new.select("hash", "label"), new.where("was <> label").limit(1).count()
        if not moved:
            break
    labelled = images.select("key", "hash").join(labels, "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("group_key"))
    return labelled.join(least, "label", "left").select("key", F.coalesce("group_key", "key").alias("group_key"))


def best_overlap(boxes: DataFrame, predictions: DataFrame) -> DataFrame:
    """(key, line_no, cls, predicted, iou, conf): each box's best prediction, the earlier of equals."""
    from ..functions import geometry as G

    mine, theirs = G.corners(), {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    pairs = boxes.select("key", "line_no", "cls", *(v.alias(f"b{k}") for k, v in mine.items())).join(predictions, "key")
    pairs = pairs.withColumn("iou", G.iou({k: F.col(f"b{k}") for k in mine}, theirs))
    w = Window.partitionBy("key", "line_no").orderBy(F.desc("iou"), "ord")
    return pairs.withColumn("place", F.row_number().over(w)).where("place = 1").select("key", "line_no", "cls", "predicted", "iou", "conf")


def class_swaps(best: DataFrame, min_iou: float = 0.60, min_conf: float = 0.55, least: int = 2) -> DataFrame:
    """(cls, predicted, n) of confident disagreements that recur; experimental, as a model errs too."""
    odd = best.where((F.col("iou") >= min_iou) & (F.col("conf") >= min_conf) & (F.col("predicted") != F.col("cls")))
    return odd.groupBy("cls", "predicted").agg(F.count("*").alias("n")).where(F.col("n") >= least)
