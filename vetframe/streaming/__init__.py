"""Extension: the row checks over a stream of label rows.  The batch engine needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rows


def stream_hits(boxes: DataFrame, nc: int = 0) -> DataFrame:
    """(type, key, line_no) of arriving boxes; the checks keep no state."""
    return rows.row_hits(boxes, rows.geometry_checks(nc))


def windowed_counts(boxes: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", nc: int = 0) -> DataFrame:
    """Hits of each type in each window of arrival; later rows than ``late`` are dropped by the watermark."""
    found = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in rows.geometry_checks(nc).items())))
    marked = boxes.withWatermark(time, late).select(F.col(time), F.explode(found).alias("type"))
    return marked.groupBy(F.window(time, width), "type").agg(F.count("*").alias("n"))


def audit_deliveries(boxes: DataFrame, out: str, checkpoint: str, nc: int = 0):
    """Append the hits of each arriving batch to ``out``; a batch that is repeated overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows.row_hits(batch, rows.geometry_checks(nc)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return boxes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
