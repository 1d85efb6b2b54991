"""Language-model scoring with a hidden Markov model over word classes.

A word's class is the word itself for the ``OWN`` most frequent words, else a
hashed cell of its last bytes.  Hidden states emit classes; within a class a
word has (c + 1) / D, D the sum of c + 1 over the class's known words plus one
for an unknown word, so the model is a distribution over texts.  The sum of
log10(c + 1) is shared with the base score, and

    score = sum log10(c + 1) - sum log10(D of the class) + log10 P(classes).

Word counts cover all training documents and are joined to the tokens of all
documents by hash; the most frequent words, ``COMMON`` at most, are broadcast,
so no frequent word meets the join.  Baum-Welch counts are summed across
partitions by Spark.  Training begins with ``ROUNDS`` rounds over one of
``SLOTS`` slots of the sequences each, which only form the states: their counts
pass on to the next round and are then dropped.  ``SWEEPS`` rounds over all
training sequences follow, and the model is what the last of them counts, where
each training token gives its expected counts once.  For these counts sequences are
cut into segments of ``SEGMENT`` tokens, each of which begins with the states of
the model's long run; the score is the exact scaled forward recursion over the
whole sequence.  Slots go by a hash of the row's id and classes, so the model
doesn't depend on how rows are partitioned (but for the order of float sums).

Words are identified by 64-bit hashes of their lower-cased bytes.

Defined results: null and empty texts are the end token alone; with no training
document c, N and V are 0, every word is unknown, and base_score is 0; repeated
rows count as often as they occur; a null id counts as an empty text in the
remainder, so such rows are learnt from or held out together; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATES = 8
OWN = 1024
COMMON = 65_536
CELLS = 1024
SUFFIX = 3
#: Classes: own words, cells, the end.
END = OWN + CELLS
CLASSES = END + 1
SLOTS, ROUNDS, SWEEPS, SEGMENT = 64, 8, 2, 128
#: Cells an octave in the histogram of word counts.
STEPS = 64


class Words:
    """Hash and cell of every word of a slice of texts."""

    def __init__(self) -> None:
        self.hash, self.lower = common.SpanHasher(), common._lower()

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (signed), cell and document of each word."""
        raw, offsets = common.text_buffer(text)
        raw = self.lower[raw]
        start, end, doc = common.word_spans(raw, offsets)
        cell = np.zeros(len(start), np.uint64)
        for i in range(1, SUFFIX + 1):
            at = end - i
            cell = cell * np.uint64(257) + np.where(at >= start, raw[np.maximum(at, 0)] if len(raw) else 0, 0).astype(np.uint64)
        cell = (cell * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        return self.hash(raw, start, end).view(np.int64), cell.astype(np.int64), doc


def count_words(train: DataFrame) -> DataFrame:
    """(h, cell, c) of every distinct word of ``train``; a task sums what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            h, cell, n = map(np.concatenate, zip(*held, strict=True))
            found, first, which = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(cell[first].astype(np.int16)), pa.array(np.bincount(which, n, len(found)).astype(np.int64))], ["h", "cell", "n"])

        for batch in batches:
            for part in common.slices(batch, limit=2_000_000):
                h, cell, _ = words(part.column(0))
                found, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((found, cell[first], n))
                size += len(found)
                if size > 1_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    partial = train.select("text").mapInArrow(run, "h long, cell short, n long")
    return partial.groupBy("h").agg(F.first("cell").alias("cell"), F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that ``most`` of them at most exceed.

    A sort with a limit would send ``most`` rows of every task to one place; the
    limit is read from a histogram of the counts with ``STEPS`` cells an octave.
    """
    cell = F.floor(F.log2("c") * STEPS).cast("int")
    sizes = {r["cell"]: r["n"] for r in counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # 64 * STEPS at most
    least, held = None, 0
    for c in sorted(sizes, reverse=True):
        held += sizes[c]
        if held > most:
            break
        least = c
    return counts.where(F.lit(False) if least is None else cell >= least)


class Lexicon:
    """What all tasks need to know of the counts: the common words, and the totals of every class."""

    def __init__(self, spark: SparkSession, train: DataFrame) -> None:
        self.counts = common.materialise(spark, count_words(train), "words")
        n_docs = train.count()
        total = self.counts.agg(F.sum("c"), F.count("*")).first()
        self.tokens = (total[0] or 0) + n_docs
        self.types = total[1] + (n_docs > 0)
        top = most_frequent(self.counts, COMMON).collect()  # COMMON at most
        own = sorted(top, key=lambda r: (-r["c"], r["h"]))[:OWN]
        top.sort(key=lambda r: r["h"])
        self.h = np.array([r["h"] for r in top], np.int64)
        self.c = np.array([r["c"] for r in top], np.int64)
        place = {r["h"]: i for i, r in enumerate(own)}
        self.own = np.array([place.get(r["h"], -1) for r in top], np.int64)
        cells = self.counts.groupBy("cell").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # CELLS at most
        size, weight = np.ones(CLASSES), np.zeros(CLASSES)
        for r in cells:
            size[OWN + r["cell"]] += r["c"] + r["v"]
            weight[OWN + r["cell"]] += r["c"]
        for i, r in enumerate(own):
            size[i], weight[i] = r["c"] + 1, r["c"]
            size[OWN + r["cell"]] -= r["c"] + 1
            weight[OWN + r["cell"]] -= r["c"]
        size[END], weight[END] = n_docs + 1, n_docs
        self.log_size, self.weight, self.n_docs = np.log10(size), weight, n_docs


def sequences(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: class sequence, what the common words give, and the hashes of the other words."""
    h_known, c_known, own = lexicon.h, lexicon.c, lexicon.own
    end_known, end_log = int(lexicon.n_docs > 0), math.log10(lexicon.n_docs + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in common.slices(batch, limit=2_000_000):
                rows = part.num_rows
                h, cell, doc = words(part.column(1))
                found, which = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(h_known, found), max(len(h_known) - 1, 0))
                hit = h_known[at] == found if len(h_known) else np.zeros(len(found), bool)
                one = np.where(hit, own[at], -1) if len(h_known) else np.full(len(found), -1)
                log_c = np.where(hit, np.log10(c_known[at] + 1.0), 0.0) if len(h_known) else np.zeros(len(found))
                is_common, mine = hit[which], one[which]
                classes = np.where(mine >= 0, mine, OWN + cell).astype("<u2")
                n = np.bincount(doc, minlength=rows)
                ends = np.cumsum(n)
                with_end = np.insert(classes, ends, END).astype("<u2")
                at = np.r_[0, np.cumsum(n + 1)]
                raw = with_end.tobytes()
                # the other words, each once a document
                rare = np.flatnonzero(~is_common)
                key, times = np.unique(doc[rare] * np.int64(len(found)) + which[rare], return_counts=True)
                r_doc, r_h = key // max(len(found), 1), found[key % max(len(found), 1)] if len(key) else h[:0]
                r_at = np.r_[0, np.cumsum(np.bincount(r_doc, minlength=rows))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n + 1, pa.int64()),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                        pa.array(np.bincount(doc, is_common, rows).astype(np.int64) + end_known),
                        pa.array(np.bincount(doc, log_c[which], rows) + end_log),
                        pa.ListArray.from_arrays(pa.array(r_at, pa.int32()), pa.array(r_h)),
                        pa.ListArray.from_arrays(pa.array(r_at, pa.int32()), pa.array(times, pa.int32())),
                    ],
                    ["doc_id", "held_out", "n_tokens", "classes", "known", "log_c", "rare", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, classes binary, known long, log_c double, rare array<long>, times array<int>")


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, weight: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(self.move, 0.95)
        self.prior = (weight + 1) / (weight + 1).sum()
        b = self.prior * np.exp(rng.normal(0, 0.7, (STATES, CLASSES)))
        self.emit = b / b.sum(1, keepdims=True)

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts over segments given one after another: starts, moves, emissions, in one vector."""
        k = STATES
        starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        n_seg = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), n_seg)
        place = common.rank_in_groups(doc)
        begin = (np.cumsum(lengths) - lengths)[doc] + place * SEGMENT
        size = np.minimum(SEGMENT, lengths[doc] - place * SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, place = begin[order], size[order], place[order]
        emit = np.ascontiguousarray(self.emit.T).astype(np.float32)
        move = self.move.astype(np.float32)
        first, usual = self.start.astype(np.float32), np.linalg.matrix_power(self.move.T, 256).mean(1).astype(np.float32)
        for lo in range(0, len(begin), 8192):
            at, n = begin[lo : lo + 8192], size[lo : lo + 8192]
            steps = int(n[0])
            active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # segments that reach step t
            alpha, scale, seen = [], [], []
            a = np.where(place[lo : lo + 8192, None] == 0, first, usual)
            for t in range(steps):
                m = int(active[t])
                o = classes[at[:m] + t]
                e = emit[o]
                a = (a[:m] if t == 0 else a[:m] @ move) * e
                s = a.sum(1, keepdims=True) + np.float32(1e-30)
                a = a / s
                alpha.append(a)
                scale.append(s)
                seen.append((o, e))
            beta = np.ones((0, k), np.float32)
            for t in range(steps - 1, -1, -1):
                m = int(active[t])
                if len(beta) < m:
                    beta = np.concatenate([beta, np.ones((m - len(beta), k), np.float32)])
                gamma = alpha[t] * beta
                gamma /= gamma.sum(1, keepdims=True) + np.float32(1e-30)
                for s in range(k):
                    emissions[:, s] += np.bincount(seen[t][0], gamma[:, s], CLASSES)
                if t == 0:
                    starts += gamma[place[lo : lo + m] == 0].sum(0)
                else:
                    back = seen[t][1] * beta / scale[t]
                    moves += move * (alpha[t - 1][:m].T @ back)
                    beta = back @ move.T
        return np.concatenate([starts, moves.ravel(), emissions.T.ravel()])

    def update(self, total: np.ndarray) -> None:
        """The probabilities that the expected counts give, each with a little of the prior."""
        k = STATES
        starts, moves, emissions = total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, CLASSES)
        self.start = (starts + 0.1) / (starts + 0.1).sum()
        moves = moves + 0.1
        self.move = moves / moves.sum(1, keepdims=True)
        emissions = emissions + self.prior * 50 + 1e-3 / CLASSES
        self.emit = emissions / emissions.sum(1, keepdims=True)

    def log10_probability(self, sequences_: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over whole sequences, many side by side, longest first."""
        size = np.array([len(s) for s in sequences_])
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(size))
        if not len(size) or not size.max():
            return out
        classes = np.concatenate([sequences_[i] for i in order]).astype(np.int64)
        n = size[order]
        begin = np.cumsum(n) - n
        emit, move = np.ascontiguousarray(self.emit.T), self.move
        active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right").tolist()
        log = np.zeros(len(n))
        a = np.broadcast_to(self.start, (len(n), STATES))
        for t, m in enumerate(active):
            if m < len(a):  # those that have ended
                log[m : len(a)] += np.log10(a[m:].sum(1))
                a = a[:m]
            a = (a if t == 0 else a @ move) * emit[classes[begin[:m] + t]]
            if t % 8 == 7:
                s = a.sum(1)
                log[:m] += np.log10(s)
                a /= s[:, None]
        log[: len(a)] += np.log10(a.sum(1))
        out[order] = log
        return out


def _classes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in column.to_pylist()]


def count_round(rows: DataFrame, model: Hmm) -> np.ndarray:
    """Expected counts of all ``rows`` (classes), summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        for batch in batches:
            parts = _classes(batch.column(0))
            while parts:
                size = np.cumsum([len(p) for p in parts])
                some = max(1, int(np.searchsorted(size, 1_000_000)))
                total += model.expected(np.concatenate(parts[:some]), np.array([len(p) for p in parts[:some]]))
                parts = parts[some:]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "x"])

    total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
    for r in rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row a parameter
        total[r["i"]] = r["x"]
    return total


def train(table: DataFrame, lexicon: Lexicon) -> tuple[Hmm, np.ndarray]:
    """The model after all rounds over the training rows of ``table``, and the counts of the last one."""
    model = Hmm(lexicon.weight)
    rows = table.where("NOT held_out").select("doc_id", "classes")
    slot = F.pmod(F.xxhash64("doc_id", "classes"), F.lit(SLOTS))
    formed = np.zeros(STATES + STATES**2 + STATES * CLASSES)
    for i in range(ROUNDS):
        formed = formed * 0.3 + count_round(rows.where(slot == i).select("classes"), model)
        model.update(formed)
    for _ in range(SWEEPS):
        counts = count_round(rows.select("classes"), model)
        model.update(counts)
    return model, counts


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    marked = docs.select("doc_id", "text", (common.remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    lexicon = Lexicon(spark, marked.where("NOT held_out"))
    table = common.materialise(spark, sequences(marked, lexicon).withColumn("row", F.monotonically_increasing_id()), "sequences")
    model, _ = train(table, lexicon)
    log_size = lexicon.log_size

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _classes(batch.column(6))
            p = model.log10_probability(parts) - np.array([log_size[s].sum() for s in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(p)], ["row", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_p"])

    scored = table.select("row", "doc_id", "held_out", "n_tokens", "known", "log_c", "classes").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, log_c double, log_p double")
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("n"))
    found = rare.join(lexicon.counts.select("h", "c"), "h").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    joined = scored.join(found, "row", "left").na.fill(0, ["more_known", "more"])
    log_all = math.log10(lexicon.tokens + lexicon.types + 1)
    total = F.col("log_c") + F.col("more")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (total + F.col("log_p")).alias("score"),
    )
