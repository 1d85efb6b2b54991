"""Label rows of text files: numbered, parsed, and explained where they cannot be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Every line end that splits text: CR LF first, then the single ones.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
NUMBER = r"(?i)^[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?)$"


def number(token: Column) -> Column:
    """A token as a float; null if it is none.  Digit groups may be joined by underscores; type suffixes are no part of a number."""
    low = F.lower(F.regexp_replace(token, "_", ""))
    sign = F.when(low.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    bare = F.regexp_replace(low, "^[+-]", "")
    special = F.when(bare.startswith("inf"), sign * F.lit(float("inf"))).when(bare == "nan", F.lit(float("nan")))
    return F.when(F.regexp_like(token, F.lit(NUMBER)), F.coalesce(special, low.try_cast("double")))


def lines(files: DataFrame) -> DataFrame:
    """(key, line_no, raw) of the rows that are not blank; blank ones are counted."""
    numbered = files.select("key", F.posexplode(F.split("content", LINE_END)).alias("pos", "text"))
    raw = F.regexp_replace("text", r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")
    return numbered.select("key", (F.col("pos") + 1).alias("line_no"), raw.alias("raw")).where("raw <> ''")


def parse(rows: DataFrame, task: str = "detect", n_kpt: int = 0, kpt_dim: int = 3) -> tuple[DataFrame, DataFrame]:
    """Boxes and parse errors of (key, line_no, raw)."""
    fields = rows.withColumn("f", F.split("raw", r"[\s\x{A0}]+")).withColumn("n", F.size("f"))
    values = fields.withColumn("v", F.transform("f", number))
    first = F.get(F.col("v"), 0)
    finite = ~F.isnan(first) & (F.abs(first) != float("inf"))
    numeric = ~F.exists("v", lambda x: x.isNull()) & finite & (F.abs(first) < 2**31)
    n = F.col("n")
    if task == "segment":
        right, expected = G.polygon_width(n), F.lit("expected a class and three or more points, an odd count of 7 fields or more, found ")
    else:
        want = 5 + (n_kpt * kpt_dim if task == "pose" else 0)
        right, expected = n == want, F.lit(f"expected {want} fields, found ")
    reason = F.when(~right, F.concat(expected, n.cast("string"))).when(~F.coalesce(numeric, F.lit(False)), F.lit("non-numeric field"))
    judged = values.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    at = lambda i: F.get(F.col("v"), i)
    cls = first.cast("int").alias("cls")
    none_p, none_k = F.lit(None).cast("array<struct<x:double,y:double>>"), F.lit(None).cast("array<struct<x:double,y:double,v:double>>")
    if task == "segment":
        points = F.transform(F.sequence(F.lit(1), n - 2, F.lit(2)), lambda i: F.struct(F.get(F.col("v"), i).alias("x"), F.get(F.col("v"), i + 1).alias("y")))
        shaped = good.withColumn("polygon", points)
        values_of = {c: F.col(f"polygon.{c}") for c in "xy"}
        low, high = ({c: f(v) for c, v in values_of.items()} for f in (F.array_min, F.array_max))
        box = [((low["x"] + high["x"]) / 2).alias("xc"), ((low["y"] + high["y"]) / 2).alias("yc"), (high["x"] - low["x"]).alias("w"), (high["y"] - low["y"]).alias("h")]
        boxes = shaped.select("key", "line_no", cls, *box, "raw", "polygon", none_k.alias("keypoints"))
    else:
        points = none_k
        if task == "pose" and n_kpt:
            base = lambda i: F.lit(5) + i * kpt_dim
            flag = (lambda i: F.get(F.col("v"), base(i) + 2)) if kpt_dim == 3 else (lambda i: F.lit(2.0))
            points = F.transform(F.sequence(F.lit(0), F.lit(n_kpt - 1)), lambda i: F.struct(F.get(F.col("v"), base(i)).alias("x"), F.get(F.col("v"), base(i) + 1).alias("y"), flag(i).alias("v")))
        boxes = good.select("key", "line_no", cls, at(1).alias("xc"), at(2).alias("yc"), at(3).alias("w"), at(4).alias("h"), "raw", none_p.alias("polygon"), points.alias("keypoints"))
    return boxes, judged.where("reason IS NOT NULL").select("key", "line_no", "raw", "reason")
