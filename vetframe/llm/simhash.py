"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into three blocks.  Two fingerprints that differ in at most
``DISTANCE`` = 4 bits differ in at most one bit of some block.  The anchors of a
block are a covering code: its first 15 bits take the words of the perfect
Hamming [15, 11] code (covering radius 1), its other bits are free.  A
fingerprint is at home at its one anchor within the covering radius, and is
replicated to every anchor within radius plus threshold, 1 + 1.  If x and y
agree up to one bit in the block, y is among the replicas at the home of x, so
comparing homes with replicas at each anchor loses no link.

The homes at an anchor grow with the number of fingerprints, and with them the
comparisons of each.  From ``MANY`` distinct ones on blocks are twice as wide:
the 64 bits are cut into five, of which some two together differ in one bit at
most, so each of the ten pairs is a block, with 512 times as many anchors.

Equal fingerprints are one row before that, so copies never meet.  At an anchor
the links are reduced to a spanning forest at once; no list of all pairs
arises.  The homes of a crowded anchor are dealt into parts of bounded size; the
replicas stream past each part.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; rows with a null
doc_id take part, and a component whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, common
from .components import components

DISTANCE = 4
#: Runs (first bit, width) of each block.
NARROW = (((0, 21),), ((21, 21),), ((42, 22),))
WIDE = tuple(combinations(((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 2))
MANY = 1 << 28
CODED = 15
#: Homes in one part of an anchor.
CROWD = 4096
#: Rows of one anchor that a task holds.
HELD = 50_000


def fingerprint_texts(texts: list[bytes], shingle: int) -> np.ndarray:
    """64-bit SimHash of each text (UTF-8): majority of the bits of XXH64 over its word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z alone are lowered, and the six ASCII white spaces split
        if not words:
            counts.append(0)
            continue
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.r_[0, end[:-1] + 1]
        k = min(shingle, len(words))
        view = memoryview(joined)
        hashes += [digest(view[a:b], 42) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]
        counts.append(len(words) - k + 1)
    return majority(np.array(hashes, np.uint64), np.array(counts, np.int64))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of ``counts`` hashes; eight byte-wide counters are summed at once."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    runs = -(-n // 255)  # a byte counts to 255
    run_doc = np.repeat(np.arange(len(full)), runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + common.rank_in_groups(run_doc) * 255
    first = np.cumsum(runs) - runs
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * total[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprinted(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` and, last, ``fp``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, place, 2_000_000):
                texts = pc.fill_null(part.column(place), "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprint_texts(texts, shingle).view(np.int64))], [*part.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=2_000_000):
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_texts(texts, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def hamming_code() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2^15 words: its nearest code word; and the code words at distance two (seven, or none: -1)."""
    words = np.arange(1 << CODED)
    syndrome = np.zeros(len(words), np.int64)
    for i in range(CODED):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    nearest = np.where(syndrome == 0, words, words ^ (1 << np.maximum(syndrome - 1, 0)))
    second = np.full((len(words), 7), -1)
    odd = np.flatnonzero(syndrome)
    s = syndrome[odd]
    for i in range(1, CODED + 1):  # two bits i < j with i ^ j = syndrome lead to a code word
        j = s ^ i
        some = (j > i) & (j <= CODED)
        place = (second[odd[some]] >= 0).sum(1)
        second[odd[some], place] = words[odd[some]] ^ (1 << (i - 1)) ^ (1 << (j[some] - 1))
    return nearest, second


def anchors(fp: np.ndarray, nearest: np.ndarray, second: np.ndarray, blocks: tuple = NARROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row of ``fp`` and whether it is the home, for all blocks and all replicas."""
    keys, rows, home = [], [], []
    every = np.arange(len(fp))
    for number, block in enumerate(blocks):
        value, width = np.zeros(len(fp), np.int64), 0
        for shift, size in block:
            value |= ((fp >> np.uint64(shift)).astype(np.int64) & ((1 << size) - 1)) << width
            width += size
        coded, free = value & ((1 << CODED) - 1), value >> CODED
        own = nearest[coded]

        def add(code: np.ndarray, rest: np.ndarray, row: np.ndarray, at_home: bool) -> None:
            keys.append(np.int64(number) << 40 | code << 12 | rest)
            rows.append(row)
            home.append(np.full(len(row), at_home))

        add(own, free, every, True)
        for i in range(second.shape[1]):
            some = np.flatnonzero(second[coded, i] >= 0)
            add(second[coded[some], i], free[some], some, False)
        for i in range(width - CODED):
            add(own, free ^ (1 << i), every, False)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(home)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(homes: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what homes and others (which hold the homes) connect within ``distance``."""
    left, right = [], []
    label = np.arange(len(others))
    step = max(1, 4_000_000 // max(1, len(others)))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        near = popcount(some[:, None] ^ others[None, :]) <= distance
        for i in np.flatnonzero(near.sum(1) > 1):
            linked = np.flatnonzero(near[i])
            found, first = np.unique(label[linked], return_index=True)
            if len(found) == 1:
                continue
            label[np.isin(label, found)] = found[0]
            reach = others[linked[first]]
            left.append(np.full(len(reach), some[i]))
            right.append(reach)
    return (np.concatenate(left), np.concatenate(right)) if left else (homes[:0], homes[:0])


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that span the components of ``distinct`` (fp) under Hamming distance ``distance``."""
    if distance > DISTANCE:
        raise ValueError("the anchors cover one differing bit a block")
    blocks = WIDE if distinct.count() >= MANY else NARROW

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, second = hamming_code()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                key, row, home = anchors(fp, nearest, second, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def groups(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            a, b = [], []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                if e - s > 1 and home[s]:
                    n = int(home[s:e].sum())  # homes come first
                    x, y = forest(fp[s : s + n], fp[s:e], distance)
                    a.append(x)
                    b.append(y)
            none = fp[:0]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a]).view(np.int64)), pa.array(np.concatenate([none, *b]).view(np.int64))], ["a", "b"])

        for batch in batches:
            key, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((key, fp.view(np.uint64), ~home))
            if key[0] == key[-1] and len(held) > 1 and held[0][0][0] == key[0]:
                if sum(len(h[0]) for h in held) > HELD:  # its homes stay, the replicas that have come are compared
                    key, fp, home = map(np.concatenate, zip(*held, strict=True))
                    yield groups(key, fp, home)
                    held = [(key[home], fp[home], home[home])]
                continue  # one anchor goes on
            key, fp, home = map(np.concatenate, zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield groups(key[:last], fp[:last], home[:last])
            held = [(key[last:], fp[last:], home[last:])]
        if held:
            yield groups(*map(np.concatenate, zip(*held, strict=True)))

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    # an anchor with a crowd of homes is compared in parts
    crowded = spread.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowded = common.materialise(spark, crowded.select("anchor", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowded")
    if crowded.limit(1).count():
        spread = spread.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        spread = spread.withColumn("part", every).withColumn("home", F.col("home") & (F.col("part") == own))
        spread = spread.withColumn("anchor", F.col("anchor").bitwiseXOR(F.call_function("shiftleft", F.col("part").cast("long"), F.lit(44))))
    # homes first in every anchor
    dealt = spread.select("anchor", "fp", (~F.col("home")).alias("away"))
    dealt = dealt.repartition(F.col("anchor")).sortWithinPartitions("anchor", "away")
    return dealt.mapInArrow(compare, "a long, b long")


class NearDuplicates:
    """Fingerprints of all documents and the component of every linked fingerprint."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int = 4, distance: int = DISTANCE) -> None:
        self.docs = common.materialise(spark, fingerprints(docs, shingle), "fingerprints")
        distinct = common.materialise(spark, self.docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
        edges = common.materialise(spark, links(spark, distinct, distance), "links")
        labels = components(spark, edges).withColumnRenamed("node", "fp")
        alone = distinct.join(labels, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("n").alias("component_size"))
        linked = common.materialise(spark, distinct.join(labels, "fp"), "linked")
        groups = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
        self.classes = alone.unionByName(common.look_up(linked, groups, "label", common.crowded_keys(linked, "label")).select("fp", "component_id", "component_size"))

    def members(self) -> DataFrame:
        """doc_id, fp, component_id, component_size of every document."""
        return common.look_up(self.docs, self.classes, "fp", common.crowded_keys(self.docs, "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    m = NearDuplicates(spark, docs, shingle, distance).members()
    return m.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 4, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with the smallest id.

    With ``similarity`` texts are near copies by their shingles instead, and candidates are found as ``nearcopies`` says.

    A Bloom filter over the ids of rows that go lets other rows pass without a
    shuffle; of the rest those go whose id and fingerprint both do.  Rows with a null id stay; so do rows that repeat the id that stays.
    """
    if similarity is not None:
        from . import nearcopies  # which takes the fingerprints and the code from here

        return nearcopies.keep_one(spark, docs, shingle, similarity)
    mine = common.Renamed(docs)
    id_, text = mine["doc_id"], mine["text"]
    members = NearDuplicates(spark, mine.df.select(id_.alias("doc_id"), text.alias("text")), shingle, distance).members()
    gone = common.materialise(spark, members.where("doc_id <> component_id").select("doc_id", "fp").distinct(), "gone")
    ids = gone.select(F.col("doc_id").alias("gone"))
    bits = bloom.filter_bits(gone.count())
    maps = common.materialise(spark, bloom.bitmaps(ids, [F.col("gone")], bits), "gone-cells")
    seen = bloom.probe(mine.df, maps, [id_], bits)
    maybe = seen.where("maybe").drop("maybe")
    printed = fingerprinted(maybe, mine.name("text"), shingle)
    stay = printed.join(gone, (printed["fp"] == gone["fp"]) & (printed[mine.name("doc_id")] == gone["doc_id"]), "left_anti")
    return mine.back(seen.where("NOT maybe").select(*mine.columns).unionByName(stay.select(*mine.columns)))
