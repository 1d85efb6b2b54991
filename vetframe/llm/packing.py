"""Shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` ids.  Only
the histogram of piece lengths (``capacity`` counts at most) reaches the
driver.  There the lengths are placed longest first; a length goes to the
shortest open pack that it fits, for as many packs of that pattern as there
are, and the counts of the packing patterns are updated.  The patterns are then
joined back to the pieces by rank: the r-th piece of a length takes the r-th
place that the patterns hold for that length.

Ranks are counted within salted buckets of each length, as many as its count
asks for, so a length that most pieces share is spread over many tasks.

Defined results: a null text is an empty one (its single id is the end id);
repeated rows are packed once each, null ids like any other; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

Entry = tuple[int, int, int, int, int]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Entry]:
    """Places for every piece: (length, first rank, how many, first sequence, offset).

    Places of one entry lie in consecutive sequences.  Packs with the same
    content are one pattern with a count; the open patterns are kept by the
    space that is left.
    """
    # open patterns: space left -> [(content, count)]; a heap gives the most space, that is the shortest pack
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    heap: list[int] = []
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(content: tuple[int, ...], count: int, left: int) -> None:
        if not left:
            closed.append((content, count))
            return
        if left not in open_:
            open_[left] = []
            heapq.heappush(heap, -left)
        open_[left].append((content, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        made: list[tuple[tuple[int, ...], int, int]] = []
        while todo:
            while heap and not open_[-heap[0]]:
                del open_[-heapq.heappop(heap)]
            if not heap or -heap[0] < length:
                # whole new packs: as many of this length as fit side by side would fill them unevenly, so one each
                made.append(((length,), todo, capacity - length))
                break
            left = -heap[0]
            content, count = open_[left].pop()
            used = min(count, todo)
            todo -= used
            if count > used:
                open_[left].append((content, count - used))
            if left - length >= length and todo:
                put((*content, length), used, left - length)
            else:
                made.append(((*content, length), used, left - length))
        for x in made:
            put(*x)
    closed += [x for left in open_.values() for x in left]

    ranks = dict.fromkeys(histogram, 0)
    entries, sequence = [], 0
    for content, count in closed:
        offset = 0
        for length in content:
            entries.append((length, ranks[length], count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return entries


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; every document ends with ``end_id``."""
    v = bpe.Vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(v)
        for batch in batches:
            for part in common.slices(batch, limit=common.STEP_BYTES):
                ids, at = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                # room for the end id of every document
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                size = np.diff(at)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                start = common.rank_in_groups(doc) * capacity
                length = np.minimum(capacity, size[doc] - start)
                first = at[:-1][doc] + start
                view = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(size[doc], pa.int64())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(spark: SparkSession, docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 0, per_bucket: int = 1_000) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    common.bound_batches(spark)
    cut = common.materialise(spark, pieces(docs, vocabulary_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    entries = np.array(sorted(shortest_pack_first(counts, capacity)), np.int64).reshape(-1, 5)

    # rank of a piece among those of its length: pieces in earlier buckets, then its place in its own
    n_buckets = F.get(F.array(*(F.lit(common.buckets_for(counts.get(n, 0), per_bucket)) for n in range(capacity + 1))), F.col("length").cast("int"))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), n_buckets))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("place", F.row_number().over(place) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))

    stride = np.int64(1) << 40
    keys = entries[:, 0] * stride + entries[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            sequence = entries[at, 3] + rank - entries[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(entries[at, 4], pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(assign, out)
