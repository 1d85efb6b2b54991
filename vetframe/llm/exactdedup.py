"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass one sets two cells for the hash of every normalised text and keeps, as
bitmaps, the cells that were set twice or more (``bloom``).  Pass two reads the
bitmaps: a text whose cells were all set twice may repeat; every other text is
certainly alone and passes straight through.  Only possibly repeated rows are
shuffled and grouped, by the SHA-256 of the normalised text, so a false
positive of the filter costs a little work and never changes a result.

Defined results: null counts as empty; of equal texts the row with the most
code points stays, then the smallest doc_id in the order of its type (null
last), then one of the rows that agree in both.  A text of white space alone
equals the empty text.  Ids may be of any type that has an order; repeated ids
are rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, common



def digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE + "+", "").cast("binary"), 256)


def points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


class Repeats:
    """Hashes of all rows, the filter over them, and the groups of equal texts.

    Crowded groups, ``common.CROWDED`` at most, are broadcast, so a text that a third
    of the rows share is never shuffled to its group.
    """

    def __init__(self, spark: SparkSession, doc_id: Column, text: Column, docs: DataFrame) -> None:
        hashed = docs.select(doc_id.alias("id"), digest(text).alias("sha"), points(text).alias("points"))
        self.rows = common.materialise(spark, hashed.withColumn("row", F.monotonically_increasing_id()), "hashed")
        n = self.rows.count()
        self.bits = bloom.filter_bits(n)
        self.maps = common.materialise(spark, bloom.bitmaps(self.rows, [F.col("sha")], self.bits, least=2), "repeated")
        self.seen = self.probe(self.rows)
        # equal rows first, so that a third of the table in one group arrives as a few rows
        tied = self.seen.where("maybe").groupBy("sha", "points", "id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
        best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id", "row"))
        groups = tied.groupBy("sha").agg(F.sum("n").alias("group_size"), best.alias("best"))
        groups = groups.select("sha", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), F.col("best.row").alias("keep_row"))
        self.groups = common.materialise(spark, groups, "groups")
        self.crowded = F.broadcast(self.groups.where(F.col("group_size") > common.crowd(n)))

    def probe(self, rows: DataFrame) -> DataFrame:
        return bloom.probe(rows, self.maps, [F.col("sha")], self.bits)

    def join(self, rows: DataFrame) -> DataFrame:
        """Rows with their group."""
        rest = rows.join(self.crowded.select("sha"), "sha", "left_anti").join(self.groups, "sha")
        return rows.join(self.crowded, "sha").unionByName(rest)


def mark_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    repeats = Repeats(spark, F.col("doc_id"), F.col("text"), docs.select("doc_id", "text"))
    id_, sha = F.col("id").alias("doc_id"), F.col("sha").alias("text_sha256")
    alone = repeats.seen.where("NOT maybe").select(id_, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped = repeats.join(repeats.seen.where("maybe"))
    return alone.unionByName(grouped.select(id_, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Whole rows move only where texts may repeat.  Rows that agree in doc_id,
    length and normalised text are told apart by nothing that matters; one of
    them stays.
    """
    mine = common.Renamed(docs)
    id_, text = mine["doc_id"], mine["text"]
    repeats = Repeats(spark, id_, text, mine.df)
    seen = repeats.probe(mine.df.withColumns({"sha": digest(text), "points": points(text)}))
    best = id_.eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    # rows of crowded groups that do not stay go before the shuffle
    crowded = repeats.crowded.select("sha", F.struct("keep_id", "keep_points").alias("keep"))
    maybe = seen.where("maybe").join(crowded, "sha", "left").where("keep IS NULL OR (" + f"{mine.name('doc_id')} <=> keep.keep_id AND points = keep.keep_points)").drop("keep")
    stay = maybe.join(repeats.groups, "sha").where(best).dropDuplicates(["sha"])
    return mine.back(seen.where("NOT maybe").select(*mine.columns).unionByName(stay.select(*mine.columns)))
