"""Near copies by shingle similarity: what ``simhash.keep_one`` does where a similarity is asked for.

Candidates come from SimHash and covering-code anchors, as in ``simhash``, but over
a longer fingerprint, for at a similarity of 0.8 some 15 % of all bits differ.  It
is cut into blocks of ``CODED`` bits, the words of the Hamming code, and a
few free bits.  Rows that agree in the free bits of a block share a cell, and one
task has them all: there each is at home at its nearest code word and replicated to
those at distance two, so homes and replicas at an anchor hold every pair that
differs in one bit of the block at most.  ``plan`` has so many blocks that a pair
at 0.8 meets in none with a probability of 5 in a million at most, and less above.
Homes and replicas that meet are compared in ``PRINT`` further words of the
fingerprint, of which ``apart`` bits may differ; what that links in a cell becomes a
forest, so no list of pairs arises.  The rows so tied, a small part of all, are
compared once more where they meet, in ``WIDE`` words, so that texts which merely
share a passage don't hang together.  Among the rows that such ties connect, a block,
the similarity of whole shingle sets decides, and nothing else.

Pivots are compared with all rows of their block.  Rows stay open until they have
been a pivot, or are in the largest class of their block: two rows that are both
in it hang together already.  A block of up to ``HELD`` bytes is one task's work.
In others pivots are taken in rounds: in each the least of the open rows in each
of so many cells, four times as many as in the last round.  The rows of such a
block are dealt into parts, and a task holds ``PIVOTS`` pivots while the rows of a part stream past.

Defined results: words are those of the other operators, with A-Z lowered; a text
of fewer words than a shingle is one shingle; null and empty texts are alike.
Rows are told apart by a hash of id and text, so neither repeated nor null ids
take other rows with them; rows equal in both stay or go together.  Of a class the
smallest id stays, null last.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, common
from .components import components
from .simhash import CODED, hamming_code, majority, popcount

#: A pair at a similarity of 0.8 is missed with this probability at most.
MISS = 5e-6
#: The largest chance that a bit of two fingerprints differs at 0.8: of all sets, and of sets of ``FEW`` shingles or less.
DIFFER, DIFFER_FEW, FEW = 0.162, 0.1875, 5
#: Words of the fingerprint that are compared at an anchor, first and among tied rows, and the probability to miss a pair at 0.8 by each.
PRINT, WIDE, MISS_PRINT = 3, 12, 1e-6
#: The first word of the blocks.
BLOCKS = 16
#: Rows whose blocks leave a task at once, those of a usual cell, and those from which a cell is dealt into parts.
CHUNK, CELL, CROWD = 8192, 1 << 15, 1 << 17
#: Pairs that are compared at once, and at one anchor before pivots stand for them.
PAIRS, MANY = 1 << 18, 1 << 20
#: One row in so many tells which cells are crowded.
SHARE = 64
#: Pivots of one set of rows in the first round, and in one task.
PIVOTS = 16
#: Bytes of the shingle sets of a block that a task holds.
HELD = 8_000_000
#: Shingles whose bits are counted at once, few enough to stay in a cache.
STEP = 60_000


def shingle_hashes(text: pa.Array, hasher: common.SpanHasher, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each text has (one at least)."""
    raw, offsets = common.text_buffer(text)
    raw = common._lower()[raw]
    start, end, doc = common.word_spans(raw, offsets)
    words = hasher(raw, start, end)
    n = np.bincount(doc, minlength=len(text)).astype(np.int64)
    counts = np.maximum(n - shingle + 1, 1)
    first = np.repeat(np.cumsum(n) - n, counts)
    at = first + common.rank_in_groups(np.repeat(np.arange(len(n)), counts))
    last = np.repeat(np.cumsum(n), counts)
    out = np.zeros(len(at), np.uint64)
    for i in range(shingle):
        inside = at + i < last
        out *= np.uint64(common.MULTIPLIER)
        out[inside] += words[at[inside] + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)), counts


def plan(rows: int) -> tuple[int, int, int]:
    """Free bits of a block, so that ``rows`` make cells of about ``CELL``, and the number of blocks: the first hold all texts, the rest those of ``FEW`` shingles."""
    free = max(2, (rows // CELL).bit_length())
    met = ((1 - p) ** free * ((1 - p) ** CODED + CODED * p * (1 - p) ** (CODED - 1)) for p in (DIFFER, DIFFER_FEW))
    usual, few = (math.ceil(math.log(MISS) / math.log1p(-m)) for m in met)
    return free, usual, usual + few


def row_type(words: int) -> np.dtype:
    """A row in a cell: id, compared words and word of the code."""
    return np.dtype([("node", "<i8"), ("print", "<u8", words), ("code", "<u2")])


def apart(words: int, differ: float) -> int:
    """As many bits in ``words`` words as differ at 0.8, but for a probability of ``MISS_PRINT``."""
    bits, most, tail = 64 * words, 64 * words, 0.0
    while True:
        tail += math.comb(bits, most) * differ**most * (1 - differ) ** (bits - most)
        if tail > MISS_PRINT:
            return most
        most -= 1


def fingerprint_words(hashes: np.ndarray, counts: np.ndarray, first: int, to: int) -> np.ndarray:
    """Words ``first`` to ``to`` of the SimHash fingerprint of each text (row)."""
    out = np.empty((len(counts), to - first), np.uint64)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + STEP, side="right")))
        part = hashes[base : ends[stop - 1]]
        for word in range(first, to):
            x = part + np.uint64((word + 1) * common.MULTIPLIER & (1 << 64) - 1)
            for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x ^= x >> np.uint64(33)
                x *= np.uint64(multiplier)
            x ^= x >> np.uint64(33)
            out[at:stop, word - first] = majority(x, counts[at:stop])
        at = stop
    return out


def distinct_hashes(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes, in order, of each text."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


def spread(nodes: DataFrame, shingle: int, rows: int, compared: int = PRINT) -> DataFrame:
    """(cell, n, rows): the ``row_type`` of every row (node, text) in the cell of each block; of cells below zero, ties of equal rows."""
    free, usual, few = plan(rows)
    width = CODED + free
    per_word = 64 // width
    words, more = -(-usual // per_word), -(-few // per_word)
    kind = row_type(compared)

    def chunk(node: np.ndarray, print_: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(node, kind="stable")
        node, print_, size = node[order], print_[order], size[order]
        # rows equal in the whole fingerprint are tied to the least, which alone goes on
        least, same = np.unique(np.ascontiguousarray(print_).view(f"V{8 * print_.shape[1]}")[:, 0], return_index=True, return_inverse=True)[1:]
        again = np.flatnonzero(least[same] != np.arange(len(node)))
        if len(again):
            pairs = np.stack([node[least[same]][again], node[again]])
            yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(node[0]) & 0xFFFF)]), pa.array([0], pa.int64()), pa.array([pairs.tobytes()], pa.binary())], ["cell", "n", "rows"])
        one = np.sort(least)
        node, print_, size = node[one], print_[one], size[one]
        made = np.empty(len(node), kind)
        made["node"], made["print"] = node, print_[:, :compared]
        for block in range(few):
            some = slice(None) if block < usual else np.flatnonzero(size <= FEW)
            value = print_[some, compared + block // per_word] >> np.uint64(block % per_word * width)
            place = (value >> np.uint64(CODED)) & np.uint64((1 << free) - 1)
            if not len(place):
                continue
            mine = made[some]
            mine["code"] = value & np.uint64((1 << CODED) - 1)
            order = np.argsort(place, kind="stable")
            place, raw = place[order].astype(np.int64), mine[order].tobytes()
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            held = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * kind.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(np.int64(block) << 40 | place[cuts[:-1]]), pa.array(np.diff(cuts)), held], ["cell", "n", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.SpanHasher()
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in common.slices(batch, limit=common.STEP_BYTES):
                for at in range(0, part.num_rows, CHUNK):
                    some = part.slice(at, CHUNK)
                    sets = distinct_hashes(*shingle_hashes(some.column(1), hasher, shingle))
                    size = np.array([len(x) for x in sets])
                    print_, hashes = np.zeros((len(sets), compared + more), np.uint64), np.concatenate(sets)
                    print_[:, :compared] = fingerprint_words(hashes, size, 0, compared)
                    print_[:, compared : compared + words] = fingerprint_words(hashes, size, BLOCKS, BLOCKS + words)
                    small = np.flatnonzero(size <= FEW)
                    if len(small):
                        print_[small, compared + words :] = fingerprint_words(np.concatenate([sets[i] for i in small]), size[small], BLOCKS + words, BLOCKS + more)
                    if kept and sum(len(k[0]) for k in kept) + len(size) > CHUNK:
                        yield from chunk(*map(np.concatenate, zip(*kept, strict=True)))
                        kept = []
                    kept.append((some.column(0).to_numpy(), print_, size))
        if kept:
            yield from chunk(*map(np.concatenate, zip(*kept, strict=True)))

    return nodes.mapInArrow(run, "cell long, n long, rows binary")


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to ``n`` that links (a, b) connect each with."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def crowd_classes(print_: np.ndarray, most: int) -> np.ndarray:
    """A class for each row of an anchor: two are in one if a chain of rows within ``most`` bits leads from one to the other."""
    label, pivoted, at = np.arange(len(print_)), np.zeros(len(print_), bool), 0
    while True:
        near = popcount(print_ ^ print_[at]).sum(1) <= most
        label[np.isin(label, np.unique(label[near]))] = label[near].min()
        pivoted[at] = True
        left = np.flatnonzero(~pivoted & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        at = left[0]


def cell_ties(rows: np.ndarray, most: int, nearest: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a forest of what homes and replicas at the anchors of a cell link within ``most`` bits."""
    rows = rows[np.argsort(rows["node"], kind="stable")]
    code, print_ = rows["code"].astype(np.int64), [np.ascontiguousarray(rows["print"][:, i]) for i in range(rows["print"].shape[1])]
    far = second[code]
    away = np.flatnonzero(far[:, 0] >= 0)
    row = np.concatenate([np.arange(len(rows)), np.repeat(away, far.shape[1])]).astype(np.int32)
    key = np.concatenate([nearest[code] * 2, far[away].ravel() * 2 + 1]).astype(np.uint16)  # homes first at every anchor
    some = np.concatenate([np.ones(len(rows), bool), far[away].ravel() >= 0])
    row, key = row[some], key[some]
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    first = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
    end = np.r_[first[1:], len(key)]
    homes = np.add.reduceat((key & 1 == 0).astype(np.int64), first)
    a, b = [], []
    crowded = homes * (end - first) > MANY
    for s, e in zip(first[crowded].tolist(), end[crowded].tolist(), strict=True):
        mine = row[s:e]
        label = crowd_classes(rows["print"][mine], most)
        a.append(mine[label])
        b.append(mine)
    usual = np.flatnonzero(~crowded & (homes > 0) & (end - first > 1))
    left = common.concat_ranges(first[usual], homes[usual])
    reach = np.repeat(end[usual], homes[usual]) - left - 1  # each home with all that come after it at its anchor
    sums = np.cumsum(reach)
    at = 0
    while at < len(left):
        base = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, base + PAIRS, side="right")))
        x = np.repeat(row[left[at:to]], reach[at:to])
        y = row[common.concat_ranges(left[at:to] + 1, reach[at:to])]
        differ = np.zeros(len(x), np.uint16)
        for p in print_:
            differ += popcount(p[x] ^ p[y])
            near = np.flatnonzero(differ <= most)
            x, y, differ = x[near], y[near], differ[near]
        a.append(x)
        b.append(y)
        at = to
    none = np.zeros(0, np.int32)
    label = connected(len(rows), np.concatenate([none, *a]), np.concatenate([none, *b]))
    tied = np.flatnonzero(label != np.arange(len(rows)))
    return rows["node"][label[tied]], rows["node"][tied]


def ties(nodes: DataFrame, shingle: int, rows: int, compared: int = PRINT) -> DataFrame:
    """(a, b): links that connect the rows (node, text), some of ``rows``, whose fingerprints meet at an anchor and are near there in the ``compared`` words.

    A crowded cell is dealt into parts, and each pair of parts is a cell of its own,
    so none is beyond some bound and no pair is lost.  Which are crowded is told by one
    row in ``SHARE``: results don't depend on it.
    """
    usual, kind, most = plan(rows)[1], row_type(compared), [apart(compared, p) for p in (DIFFER, DIFFER_FEW)]

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, second = hamming_code()
        at: tuple | None = None
        held: list[bytes] = []

        def told() -> pa.RecordBatch:
            raw = b"".join(held)
            if at is None or at[0] < 0:
                a, b = np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(2, -1) for x in held)], axis=1)
            else:
                a, b = cell_ties(np.frombuffer(raw, kind), most[at[0] >> 40 >= usual], nearest, second)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for *key, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != tuple(key):
                    yield told()
                    at, held = tuple(key), []
                held.append(raw)
        yield told()

    dealt = spread(nodes, shingle, rows, compared).withColumn("pair", F.lit(0))
    if rows > CROWD:
        few = spread(nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SHARE)) == 0), shingle, rows, compared)
        sizes = few.where("cell >= 0").groupBy("cell").agg((F.sum("n") * SHARE).alias("size")).where(F.col("size") > CROWD)
        sizes = common.materialise(nodes.sparkSession, sizes.select("cell", F.ceil(F.col("size") / CROWD).cast("int").alias("parts")), "crowded-cells")
        if sizes.limit(1).count():
            parts = F.coalesce("parts", F.lit(1))
            dealt = dealt.join(F.broadcast(sizes), "cell", "left").withColumn("part", F.pmod(F.xxhash64("rows"), parts).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            dealt = dealt.withColumn("pair", F.least("part", "other") * parts + F.greatest("part", "other"))
    dealt = dealt.select("cell", "pair", "rows").repartition(F.col("cell"), F.col("pair")).sortWithinPartitions("cell", "pair")
    return dealt.mapInArrow(tie, "a long, b long")


def shingle_sets(tied: DataFrame, shingle: int) -> DataFrame:
    """node, label, doc_id and the distinct shingle hashes, in order, of rows (node, label, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.SpanHasher()
        for batch in batches:
            for part in common.slices(batch, limit=common.STEP_BYTES):
                sets = [x.tobytes() for x in distinct_hashes(*shingle_hashes(part.column(3), hasher, shingle))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["node", "label", "doc_id", "grams"])

    schema = T.StructType([*tied.select("node", "label", "doc_id").schema.fields, T.StructField("grams", T.BinaryType())])
    return tied.select("node", "label", "doc_id", "text").mapInArrow(run, schema)


def block_classes(sets: list[np.ndarray], tenths: float) -> np.ndarray:
    """A class for each set: two are in one if a chain of near copies leads from one to the other."""
    size, ids = np.array([len(x) for x in sets]), np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, held = np.cumsum(size) - size, np.zeros(int(ids.max()) + 1, bool)
    label, pivoted, at = np.arange(len(sets)), np.zeros(len(sets), bool), 0
    while True:
        mine = ids[starts[at] : starts[at] + size[at]]
        held[mine] = True
        both = np.add.reduceat(held[ids].astype(np.int64), starts)
        held[mine] = False
        near = 10 * both >= tenths * (size + size[at] - both)
        label[np.isin(label, np.unique(label[near]))] = label[near].min()
        pivoted[at] = True
        left = np.flatnonzero(~pivoted & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        at = left[0]


def small_blocks(placed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the first row of each class of a block and its other rows; (label, null) for a block beyond ``HELD`` bytes."""
    tenths = round(10 * similarity, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label: int | None = None
        nodes: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        size = 0

        def judged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if size > HELD:
                return np.array([label]), np.array([0]), np.array([True])
            node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            if len(node) < 2:
                return node[:0], node[:0], np.zeros(0, bool)
            found = block_classes(sets, tenths)
            first = np.unique(found, return_inverse=True)
            least = node[np.unique(found, return_index=True)[1]][first[1]]
            other = np.flatnonzero(least != node)
            return least[other], node[other], np.zeros(len(other), bool)

        for batch in batches:
            out = []
            labels = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)] if len(labels) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if label != labels[s]:
                    out.append(judged())
                    label, nodes, sets, size = int(labels[s]), [], [], 0
                part = batch.column(2).slice(s, e - s)
                size += int(common.text_lengths(part).sum())
                if size > HELD:
                    nodes, sets = [], []
                    continue
                nodes.append(batch.column(1).slice(s, e - s).to_numpy())
                sets += [np.frombuffer(x, np.uint64) for x in part.to_pylist()]
            yield from _edges(out)
        yield from _edges([judged()])

    dealt = placed.select("label", "node", "grams").repartition(F.col("label")).sortWithinPartitions("label", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b, none = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=none)], ["a", "b"])


class Pivots:
    """The shingle sets of a few rows, ready to be compared with many others."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        self.nodes, self.size = np.array(nodes, np.int64), np.array([len(s) for s in sets])
        owner, grams = np.repeat(np.arange(len(sets)), self.size), np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.times = np.unique(grams[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def near(self, nodes: np.ndarray, sets: list[np.ndarray], tenths: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a pivot and a row (not itself) that are near copies."""
        size, n = np.array([len(s) for s in sets]), len(self.nodes)
        grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == grams)
        times = self.times[at[hit]]
        owner = self.owner[common.concat_ranges(self.first[at[hit]], times)]
        both = np.bincount(np.repeat(row[hit], times) * n + owner, minlength=n * len(sets)).reshape(-1, n)
        r, p = np.nonzero((10 * both >= tenths * (size[:, None] + self.size - both)) & (nodes[:, None] != self.nodes))
        return self.nodes[p], nodes[r]


def compared(rows: DataFrame, pivots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pivots and rows of one (label, part, chunk) that are near copies; both have node and grams."""
    tenths = round(10 * similarity, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        held: Pivots | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key, is_row = tuple(keys[:3, s].tolist()), bool(keys[3, s])
                node = batch.column(4).slice(s, e - s).to_numpy()
                mine = [np.frombuffer(x, np.uint64) for x in batch.column(5).slice(s, e - s).to_pylist()]
                if key != at:
                    at, nodes, sets, held = key, [], [], None
                if not is_row:
                    nodes += node.tolist()
                    sets += mine
                    continue
                held = held or Pivots(nodes, sets)
                for step in range(0, len(mine), 256):
                    x, y = held.near(node[step : step + 256], mine[step : step + 256], tenths)
                    a.append(x)
                    b.append(y)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    key = ["label", "part", "chunk"]
    both = pivots.select(*key, F.lit(False).alias("is_row"), "node", "grams").union(rows.select(*key, F.lit(True).alias("is_row"), "node", "grams"))
    return both.repartition(*map(F.col, key)).sortWithinPartitions(*key, "is_row").mapInArrow(run, "a long, b long")


def classes(spark: SparkSession, placed: DataFrame, similarity: float) -> DataFrame:
    """(node, class) of the rows of ``placed`` (node, label, grams) that are near copies of another; ``label`` names their block."""
    n = placed.count()
    sizes = placed.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > common.crowd(n))
    crowded = common.materialise(spark, sizes.select("label", F.ceil(F.col("n") / common.crowd(n)).cast("int").alias("parts")), "crowded")
    crowded = F.broadcast(crowded)  # CROWDED rows at most
    parts = F.coalesce("parts", F.lit(1))
    usual = placed.select("label", "node", "grams").join(crowded.select("label"), "label", "left_anti")
    small = common.materialise(spark, small_blocks(usual, similarity), "small-blocks")
    links, large = small.where("b IS NOT NULL"), small.where("b IS NULL").select(F.col("a").alias("label"))
    rows = usual.join(large, "label").unionByName(placed.select("label", "node", "grams").join(crowded.select("label"), "label"))
    rows = rows.join(crowded, "label", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("parts")
    rows = common.materialise(spark, rows.select("label", "part", "node", "grams"), "parts")
    if rows.limit(1).count():
        links = links.unionByName(large_blocks(spark, rows, crowded, similarity))
    return components(spark, links).select("node", F.col("label").alias("class"))


def large_blocks(spark: SparkSession, rows: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect what near copies in ``rows`` (label, part, node, grams) do, found in rounds of pivots."""
    parts = F.coalesce("parts", F.lit(1))

    def every_part(df: DataFrame) -> DataFrame:
        return df.join(crowded, "label", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    open_, pivoted, links, wanted = rows.select("label", "part", "node"), None, None, PIVOTS
    while True:
        cell = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(wanted))
        chosen = open_.groupBy("label", cell.alias("cell")).agg(F.min(F.struct("node", "part")).alias("p")).select("label", F.col("p.part").alias("part"), F.col("p.node").alias("node"), F.floor(F.col("cell") / PIVOTS).cast("int").alias("chunk"))
        chosen = common.materialise(spark, chosen, "pivots")
        if not chosen.limit(1).count():
            return links
        mine = chosen.join(rows, ["label", "part", "node"]).dropDuplicates(["node"])
        pivots = every_part(mine.drop("part"))
        against = rows.join(every_part(chosen.select("label", "chunk").distinct()), ["label", "part"])
        found = common.materialise(spark, compared(against, pivots, similarity), "near")
        links = found if links is None else links.union(found)
        pivoted = chosen.select("node") if pivoted is None else pivoted.union(chosen.select("node"))
        together = components(spark, links).select("node", F.col("label").alias("class"))
        state = rows.select("label", "part", "node").join(together, "node", "left").withColumn("class", F.coalesce("class", "node"))
        state = common.materialise(spark, state, "state")
        largest = state.groupBy("label", "class").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
        left = state.join(every_part(largest), ["label", "part"]).where("class <> largest").join(pivoted, "node", "left_anti")
        open_ = common.materialise(spark, left.select("label", "part", "node"), "open")
        wanted *= 4


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when of each class of near copies only the smallest id does.

    Bloom filters let the rows that are tied to no other, and those that stay, pass without a shuffle.
    """

    def matching(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        bits = bloom.filter_bits(keys.count())
        return bloom.probe(rows, common.materialise(spark, bloom.bitmaps(keys, [F.col("node")], bits), name), [F.col("node")], bits)

    common.bound_batches(spark)
    mine = common.Renamed(docs)
    rows = mine.df.withColumn("node", F.xxhash64(mine["doc_id"], mine["text"]))
    narrow = rows.select("node", mine["doc_id"].alias("doc_id"), mine["text"].alias("text"))
    n = docs.count()
    edges = common.materialise(spark, ties(narrow.select("node", "text"), shingle, n), "ties")
    nodes = common.materialise(spark, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    tied = matching(narrow, nodes, "tied-cells").where("maybe").drop("maybe").join(nodes, "node", "left_semi")
    tied = common.materialise(spark, tied, "tied")
    edges = common.materialise(spark, ties(tied.select("node", "text"), shingle, n, WIDE), "wide-ties")
    tied = tied.join(components(spark, edges), "node")
    placed = common.materialise(spark, shingle_sets(tied, shingle), "sets")
    found = classes(spark, placed, similarity)
    members = placed.select("node", "doc_id").join(found, "node")
    stay = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best")).select(F.col("best.node").alias("node"))
    going = common.materialise(spark, members.select("node").join(stay, "node", "left_anti"), "gone")
    seen = matching(rows, going, "gone-cells")
    maybe = seen.where("maybe").join(going, "node", "left_anti")
    return mine.back(seen.where("NOT maybe").select(*mine.columns).unionByName(maybe.select(*mine.columns)))
