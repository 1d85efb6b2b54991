"""Connected components over an edge table: smallest label of the neighbours, then pointer jumping.

Every round is written to the shared folder, so a lost executor repeats one
round at most.  Nothing but the number of changes reaches the driver.  Nodes
with very many neighbours and labels of very many nodes are looked up in a
bounded broadcast (``common.look_up``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def thinned(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) that connect the same nodes as ``edges``, but in stars.

    The smaller neighbours of a node are tied to the least of them, and it to the
    node.  Nodes of one group mostly share that least one, so a group with many
    links a node keeps about one.  The neighbours of a crowded node are dealt into
    parts, each a star of its own; they stream past, and none are held.
    """
    one = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    most = common.crowd(one.count())
    crowded = one.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > most).select("b", F.ceil(F.col("n") / most).alias("parts"))
    hot, parts = common.collected(crowded), F.lit(1)  # CROWDED rows at most
    if hot is not None:
        one, parts = one.join(F.broadcast(hot), "b", "left"), F.coalesce("parts", parts)
    dealt = one.withColumn("part", F.pmod(F.xxhash64("a"), parts))
    least = F.first("a").over(Window.partitionBy("b", "part").orderBy("a"))
    star = dealt.withColumn("least", least).select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return star.distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the smallest node that can be reached.

    Labels fall along the edges, thinned to stars first, and then jump to the
    label of the label, so a chain of n links takes about log2(n) rounds.
    """
    stars = common.materialise(spark, thinned(edges), "stars")
    both = common.materialise(spark, stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = common.materialise(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    hubs = common.crowded_keys(both, "b")
    while True:
        near = common.look_up(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = common.materialise(spark, labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "lower")
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = common.materialise(spark, common.look_up(lower, of, "label", common.crowded_keys(lower, "label")).select("node", "was", F.least("label", "next").alias("label")), "labels")
        changed = new.where("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
