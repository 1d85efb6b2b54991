"""From hits to findings, verdicts, scores and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab


def findings(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """(type, severity, category, n_items, n_hits): one row a type, worst first.

    Items are counted in two steps, so a type that hits a third of all files is combined before the shuffle.
    """
    items = hits.groupBy("type", "key").agg(F.count("*").alias("n"))
    found = items.groupBy("type").agg(F.count("key").alias("n_items"), F.sum("n").alias("n_hits"))
    return found.join(F.broadcast(vocab.table(spark)), "type").select("type", "severity", "severity_rank", "category", "n_items", "n_hits").orderBy("severity_rank", F.desc("n_items"), "type")


def evidence(hits: DataFrame, cap: int = 12) -> DataFrame:
    """The first ``cap`` hits of each type in file order; tasks keep no more than that each."""
    w = Window.partitionBy("type").orderBy("key", "line_no")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def locations(hits: DataFrame) -> DataFrame:
    """(type, key, lines): the line numbers of each type in each file, in order."""
    return hits.groupBy("type", "key").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity, n) of the trainability findings."""
    return found.where("category = 'trainability'").groupBy("severity").agg(F.count("*").alias("n"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: blocked, fix_before_training or usable_with_caveats; governance never decides."""
    worst = found.where("category = 'trainability'").agg(F.min("severity_rank").alias("worst"))
    return worst.select(F.when(F.col("worst") == 0, "blocked").when(F.col("worst") == 1, "fix_before_training").otherwise("usable_with_caveats").alias("verdict"))


def should_fail(found: DataFrame, level: str) -> bool:
    """CI gate: is there a trainability finding of ``level`` or worse?  ``never`` never fails."""
    if level == "never":
        return False
    return found.where((F.col("category") == "trainability") & (F.col("severity_rank") <= vocab.RANK[level])).limit(1).count() > 0


def recheck(before: DataFrame, after: DataFrame) -> DataFrame:
    """(status, type, item): what was resolved, introduced or remains; whole item sets, never a capped list."""
    a, b = before.select("type", "item").distinct().withColumn("was", F.lit(1)), after.select("type", "item").distinct().withColumn("is", F.lit(1))
    status = F.when(F.col("is").isNull(), "resolved").when(F.col("was").isNull(), "introduced").otherwise("remaining")
    return a.join(b, ["type", "item"], "full_outer").select(status.alias("status"), "type", "item")


def score(truth: DataFrame, reported: DataFrame, collateral: DataFrame | None = None) -> DataFrame:
    """One row of hits, misses, false positives, recall and precision over facts (type, key)."""
    t, r = truth.select("type", "key").distinct().withColumn("t", F.lit(True)), reported.select("type", "key").distinct().withColumn("r", F.lit(True))
    both = t.join(r, ["type", "key"], "full_outer")
    if collateral is None:
        both = both.withColumn("c", F.lit(None).cast("boolean"))
    else:
        both = both.join(collateral.select("type", "key").distinct().withColumn("c", F.lit(True)), ["type", "key"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = both.agg(
        F.count_if(yes("t") & yes("r")).alias("hits"), F.count_if(yes("t") & ~yes("r")).alias("misses"),
        F.count_if(yes("r") & ~yes("t") & ~yes("c")).alias("false_positives"), F.count_if(yes("r") & ~yes("c")).alias("scored"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    return n.withColumns({"recall": ratio(F.col("hits"), F.col("hits") + F.col("misses")), "precision": ratio(F.col("hits"), F.col("scored"))})


def score_by_arm(scores: DataFrame) -> DataFrame:
    """Micro-averages of each arm: sums first, then ratios."""
    s = scores.groupBy("arm").agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "false_positives")))
    gt, scored = F.col("hits") + F.col("misses"), F.col("hits") + F.col("false_positives")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return s.withColumns({"recall": safe(F.col("hits"), gt), "precision": safe(F.col("hits"), scored), "f1": safe(2 * F.col("hits"), gt + scored)})


def summarise_runs(scores: DataFrame) -> DataFrame:
    """Mean and range of each arm's measure over runs."""
    return scores.groupBy("arm", "measure").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def beyond_base_rate(reported: DataFrame, on_clean: DataFrame) -> DataFrame:
    """Facts that the clean data doesn't show as well."""
    return reported.join(on_clean.select("type", "key"), ["type", "key"], "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(measure, a, b, delta) of two tables (measure, n)."""
    x, y = a.select("measure", F.col("n").alias("a")), b.select("measure", F.col("n").alias("b"))
    return x.join(y, "measure", "full_outer").na.fill(0, ["a", "b"]).withColumn("delta", F.col("b") - F.col("a"))


def types_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("type").subtract(b.select("type"))
