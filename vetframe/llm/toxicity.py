"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; other documents, labelled or
not, are the unlabelled U.  With the class prior pi and the logistic loss l the
risk of a scorer g is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]),

the second term being the negative risk corrected for the positives hidden in
U and kept from going negative; where it would, the step goes the other way.
Several linear numpy models, each trained on its own share of U, are averaged.

Features are the presence of hashed words, word beginnings and inner character
runs, the ``n_features`` most frequent in P of those whose rate in U is about pi times
that, as it is if toxic texts alone hold them.
Training reads bounded samples (``n_positive``, ``n_unlabelled`` documents,
the first by a hash of the id, of rows that share an id one); scoring reads every whole text.

Defined results: null and empty texts are scored by the model's constant; with
no confirmed toxic document every score is 0; a null doc_id is never trained
on; repeated labels of one id count once, toxic if any says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6)
INNER = 5
#: A chosen feature is at most so many times as frequent in U as toxic texts alone would make it.
PURE = 2.0


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = True
    table[128:] = True
    return table


class Features:
    """(document, bucket) of each distinct feature of a slice of texts."""

    def __init__(self) -> None:
        self.hash, self.lower, self.word = common.SpanHasher(), common._lower(), _word_bytes()

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Not made distinct: callers set bits."""
        raw, offsets = common.text_buffer(text)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = self.lower[raw]
        start, end, doc = common.word_spans(np.where(self.word[raw], raw, np.uint8(32)), offsets)
        size = end - start
        spans, kinds = [(start, end, doc)], [np.full(len(start), 1)]
        for n in BEGINNINGS:
            some = size > n
            spans.append((start[some], start[some] + n, doc[some]))
            kinds.append(np.full(int(some.sum()), 2))
        some = size > INNER
        more = size[some] - INNER
        at = common.concat_ranges(start[some] + 1, more)
        spans.append((at, at + INNER, np.repeat(doc[some], more)))
        kinds.append(np.full(len(at), 3))
        start, end, doc = map(np.concatenate, zip(*spans, strict=True))
        h = self.hash(raw, start, end) * np.uint64(2) + np.concatenate(kinds).astype(np.uint64)
        return doc, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)).astype(np.int64)


def training_row(column: Column, modulus: int = 5) -> Column:
    """Rows that may be learnt from: crc32 of the id modulo 5 is not 0."""
    return common.remainder(column, modulus) != 0


def _sample_counts(sample: DataFrame) -> DataFrame:
    """(bucket, n) of one sample: in how many of its documents each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in common.slices(batch, limit=common.STEP_BYTES):
                doc, bucket = features(part.column(0))
                once = np.unique(doc * BUCKETS + bucket) % BUCKETS
                found, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["bucket", "n"])

    return sample.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _presence(chosen: np.ndarray, text: pa.Array, features: Features, column_of: np.ndarray) -> np.ndarray:
    doc, bucket = features(text)
    x = np.zeros((len(text), len(chosen)), np.float32)
    column = column_of[bucket]
    some = column >= 0
    x[doc[some], column[some]] = 1
    return x


def _columns(chosen: np.ndarray) -> np.ndarray:
    column_of = np.full(BUCKETS, -1, np.int16)
    column_of[chosen] = np.arange(len(chosen))
    return column_of


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the constant of one linear scorer under the non-negative risk (Adam, full batches)."""
    rng = np.random.default_rng(seed)
    share = unlabelled[rng.random(len(unlabelled)) < 0.7] if len(unlabelled) > 10 else unlabelled
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (positive, share))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        sp, su = sigmoid(gp), sigmoid(gu)
        up = prior * (p.T @ (sp - 1)) / len(p)  # of pi E_P[l(g)]
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        down = (u.T @ su) / max(len(u), 1) - prior * (p.T @ sp) / len(p)  # of the corrected negative risk
        grad = up + down if negative >= 0 else -down
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def first_ids(rows: DataFrame, count: int, n: int) -> DataFrame:
    """The first ``n`` of about ``count`` distinct ids by their hash; a cut at 1.5 times that share keeps what tasks hand on to the sort small."""
    order = F.xxhash64("doc_id")
    cut = (1 << 63) - 1 if 1.5 * n >= count else int(-(1 << 63) + (1 << 64) * (1.5 * n / count))
    return rows.where(order <= F.lit(cut)).select("doc_id").distinct().orderBy(order, "doc_id").limit(n)


class Model:
    """Chosen features and the averaged scorers."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray | None) -> None:
        self.chosen, self.weights = chosen, weights

    def score(self, text: pa.Array, features: Features, column_of: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(text))
        z = _presence(self.chosen, text, features, column_of) @ self.weights[:, :-1].T + self.weights[:, -1]
        return (1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))).mean(1)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, n_positive: int = 3000, n_unlabelled: int = 12000, n_features: int = 256, models: int = 3) -> Model:
    """Train on rows whose crc32 of the id modulo 5 is not 0."""
    known = labels.where(training_row(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if not n_toxic:
        return Model(np.zeros(0, np.int64), None)
    common.bound_batches(spark)
    prior = min(max(n_toxic / n_known, 1e-4), 0.5)
    usable = docs.where(training_row(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id")
    confirmed = first_ids(known.where("toxic > 0"), n_toxic, n_positive)  # bounded, so the joins may broadcast it
    # rows that share an id give it once, so copies of one id can't fill the sample
    other = first_ids(usable, usable.agg(F.approx_count_distinct("doc_id")).first()[0], n_unlabelled)
    ids = common.materialise(spark, confirmed.withColumn("kind", F.lit(1)).union(other.withColumn("kind", F.lit(0))), "sample")
    # one text an id: the one with the smallest digest, which is combined before the shuffle
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "kind").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = common.materialise(spark, texts.select("text", "kind"), "sample-texts")
    n = {r["kind"]: r["n"] for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(np.zeros(0, np.int64), None)

    # a feature that only toxic texts hold occurs in U at pi times its rate in P; those near that are chosen
    in_p = _sample_counts(sample.where("kind = 1")).withColumnRenamed("n", "p").where(F.col("p") >= max(5, n[1] // 50))
    in_u = _sample_counts(sample.where("kind = 0")).withColumnRenamed("n", "u")
    rates = in_p.join(in_u, "bucket", "left").na.fill(0).select("bucket", (F.col("p") / n[1]).alias("p"), (F.col("u") / n[0]).alias("u"))
    best = rates.where(F.col("u") <= F.lit(PURE * prior) * F.col("p")).orderBy(F.desc("p"), "bucket").limit(n_features)
    chosen = np.array([r["bucket"] for r in best.collect()], np.int64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, column_of = Features(), _columns(chosen)
        for batch in batches:
            for part in common.slices(batch, limit=common.STEP_BYTES):
                packed = np.packbits(_presence(chosen, part.column(0), features, column_of).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), part.column(1)], ["bits", "kind"])

    rows = sample.mapInArrow(vectors, T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("kind", T.IntegerType())])).collect()  # a few bytes each
    rows.sort(key=lambda r: bytes(r["bits"]))  # the order of arrival doesn't matter
    x = {k: np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: len(chosen)] for r in rows if r["kind"] == k], np.float32) for k in (0, 1)}
    return Model(chosen, np.stack([train_nnpu(x[1], x[0], prior, seed) for seed in range(models)]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and, last, ``score``; no column of theirs may bear that name."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, column_of = Features(), _columns(model.chosen)
        for batch in batches:
            for part in common.slices(batch, place, common.STEP_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(place), features, column_of))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(spark, docs, labels))
    return scored.select("doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer doesn't call toxic, with all their columns."""
    mine = common.Renamed(docs)
    text = mine.name("text")
    named = mine.df.withColumnRenamed(text, "text")
    kept = score(named, fit(spark, docs.select("doc_id", "text"), labels)).where("score < 0.5")
    return mine.back(kept.withColumnRenamed("text", text))
