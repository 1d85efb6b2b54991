"""Shared pieces of the training-data operators.

* ``materialise`` cuts lineage with a Parquet table in the shared folder that
  ``spark.checkpoint.dir`` names.
* ``text_chunks`` walks Arrow batches in slices of bounded bytes.
* ``word_spans`` / ``word_hashes`` find and hash words straight on the UTF-8
  buffers of Arrow string columns.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one vectorised step handles (a longer text is one step).
CHUNK_BYTES = 6_000_000
#: The same where each byte of text takes some 60 of the step's arrays, which a worker then keeps.
STEP_BYTES = 250_000


#: Paths of the tables this process has written.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), f'vetframe-{os.getuid()}')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation.

    Tables are removed when the process ends, or by ``release``.
    """
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    remember(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a session that names no size has for Arrow batches, and the size it gets here.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB at most from here on, unless the session names another size than Spark's 64 MB.

    Each task holds a batch on both sides of its pipe, and long texts fill any size.
    """
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def remember(path: str) -> None:
    """Have ``path`` removed in the end."""
    if not _written:
        atexit.register(release)
    _written.append(path)


def release(since: int = 0) -> None:
    """Remove the tables written after the first ``since`` ones; nothing may read them any more."""
    context = SparkContext._active_spark_context
    while context is not None and context._jsc is not None and len(_written) > since:
        with contextlib.suppress(Py4JError, OSError):  # at the end of a process its JVM may be gone
            path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    """How many tables there are, for ``release``."""
    return len(_written)


#: A key with more than one in so many of the rows is crowded; there are no more such keys than that.
CROWDED = 4096


def crowd(rows: int) -> int:
    """How many rows of ``rows`` a key holds at most without being crowded."""
    return max(1000, rows // CROWDED)


def crowded_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The crowded keys of ``rows``, a table that was written, or None."""
    n = rows.count()
    if n <= crowd(0):
        return None
    return collected(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > crowd(n)).select(key))  # CROWDED at most


def collected(few: DataFrame) -> DataFrame | None:
    """The rows of a small ``few`` by way of the driver, or None; as Arrow, for a list would start Python workers on all executors."""
    rows = few.toArrow()
    return few.sparkSession.createDataFrame(rows, few.schema) if rows.num_rows else None


def look_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table``, in which ``key`` is unique.

    What ``table`` says of the crowded keys ``hot`` is broadcast, so no task
    meets all rows of one key.
    """
    if hot is None:
        return rows.join(table, key)
    hot = F.broadcast(hot)
    usual = rows.join(hot, key, "left_anti").join(table, key)
    return usual.unionByName(rows.join(F.broadcast(table.join(hot, key, "left_semi")), key))


class Renamed:
    """``docs`` with its columns named by position, so that no name of an operator clashes with one of theirs."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.df = docs.toDF(*self.columns)

    def name(self, column: str) -> str:
        """The positional name of ``column``: the one spelt so, else one that differs in case."""
        lower = [n.lower() for n in self.names]
        return self.columns[self.names.index(column) if column in self.names else lower.index(column.lower())]

    def __getitem__(self, column: str) -> Column:
        return F.col(self.name(column))

    def back(self, df: DataFrame) -> DataFrame:
        """The user's columns of ``df``, under their own names."""
        return df.select(*self.columns).toDF(*self.names)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many buckets keep each near ``per_bucket`` rows."""
    return max(1, -(-rows // per_bucket))


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes at most (one row at least)."""
    at, text = 0, batch.column(column)
    if not batch.num_rows:
        return
    ends = np.cumsum(text_lengths(text))
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_lengths(text: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry at the end)."""
    import pyarrow.compute as pc

    text = pc.fill_null(text, "") if text.null_count else text
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word ``[^\\x20\\x09-\\x0D]+``; words end with their document."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~_is_space()[raw]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = word[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Modulus and bases of the span hashes.  A prime: modulo a power of two, long words of two letters collide for any base.
PRIME = (1 << 31) - 1
BASES = (1_170_943_853, 1_903_280_177)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo ``PRIME``, in 32 bits each."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(PRIME)
        have, step = have + more, step * step % PRIME
    return out.astype(np.uint32)


class SpanHasher:
    """62-bit hashes of spans, mixed to 64: two prefix polynomials modulo a prime, shifted to the start of the span."""

    #: Units summed at once, few enough to stay in a cache.
    BLOCK = 1 << 15

    def __init__(self) -> None:
        self.size = 0
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.total, self.term = np.zeros(1, np.uint64), np.zeros(self.BLOCK, np.uint64)

    def _sums(self, units: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Sums of the terms before each unit; terms stay below 2^32, so that 2^31 of them don't overflow."""
        total, carry, prime = self.total, np.uint64(0), np.uint64(PRIME)
        for at in range(0, len(units), self.BLOCK):
            part = units[at : at + self.BLOCK]
            term = self.term[: len(part)]
            np.add(part, 1, out=term, casting="unsafe")
            term *= up[at : at + len(part)]
            np.add(term & prime, term >> np.uint64(31), out=term)
            term[0] += carry
            np.cumsum(term, out=total[at + 1 : at + 1 + len(part)])
            carry = total[at + len(part)]
        return total

    def __call__(self, units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n, prime = len(units) + 1, np.uint64(PRIME)
        if self.size < n:
            self.size = n + n // 4
            self.tables = [(powers(b, self.size), powers(pow(b, -1, PRIME), self.size)) for b in BASES]
            self.total = np.zeros(self.size, np.uint64)
        h = np.zeros(len(start), np.uint64)
        for i, (up, down) in enumerate(self.tables):
            total = self._sums(units, up)
            part = (total[end] - total[start]) % prime * down[start] % prime
            h |= part << np.uint64(31 * i)
        h ^= (end - start).astype(np.uint64) << np.uint64(40)
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def rank_in_groups(groups: np.ndarray) -> np.ndarray:
    """Place of each row in its run; ``groups`` is sorted."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def concat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` entries, then the same for the next, in one array."""
    if not len(length) or not length.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) - np.repeat(ends - length - start, length)


def batches(table: pa.Table | Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches() if isinstance(table, pa.Table) else table
