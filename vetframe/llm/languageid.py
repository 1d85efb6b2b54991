"""Language identification with string kernels.

A text is the set of its byte n-grams, n = 1 to 4 blended, in hashed cells; the
kernel of two texts is the number of cells both hold over the root of the
product of their sizes.  ``landmarks`` training texts give a Nyström map, on
which one-versus-rest kernel ridge regression is solved.  Scoring takes whole
texts in batches: presence matrix times landmark matrix, then times the
coefficients.

Training reads a bounded sample of labelled rows: ``n_train`` in all, or ``LEAST``
a language where there are many, shared evenly by the languages, the first by a
hash of the id; of rows that share an id one.  Every language is learnt, with
``landmarks`` in all or two of its own.

Defined results: null texts and texts without a letter are ``und`` with score
0, and so is every text if nothing can be learnt; rows with a null lang or a null id
are not trained on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of the cells for n-grams of 1, 2, 3 and 4 bytes.
CELLS = (8, 12, 13, 13)
START = tuple(sum(1 << b for b in CELLS[:i]) for i in range(len(CELLS)))
WIDTH = sum(1 << b for b in CELLS)
#: Training rows and landmarks that each language has at least.
LEAST, OWN_MARKS = 16, 2
#: Texts in one presence matrix.
ROWS = 128


def _folded() -> np.ndarray:
    """Lower-cased bytes; what is no letter is a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def presence(text: pa.Array) -> np.ndarray:
    """Which cells each text holds, as bytes 0 and 1."""
    raw, offsets = common.text_buffer(text)
    out = np.zeros((len(text), WIDTH), np.uint8)
    if not len(raw):
        return out
    raw = _folded()[raw].astype(np.uint32)
    doc = np.repeat(np.arange(len(text)) * WIDTH, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))  # bytes to the end of the text
    gram = np.zeros(len(raw), np.uint32)
    flat = out.reshape(-1)
    for n, bits in enumerate(CELLS, 1):
        size = len(raw) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] << np.uint32(8)) | raw[n - 1 :]
        cell = gram if n == 1 else (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        inside = left[:size] >= n
        flat[(doc[:size] + START[n - 1] + cell)[inside]] = 1
    return out


class Model:
    """Landmark cells, the size of each landmark, coefficients and languages."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray) -> None:
        self.languages = languages
        self.cells = np.flatnonzero(landmarks.any(0))  # the others meet no landmark
        self.matrix = np.ascontiguousarray((landmarks[:, self.cells] / np.sqrt(np.maximum(landmarks.sum(1), 1))[:, None]).T.astype(np.float32))
        self.coefficients = coefficients.astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1)).astype(np.float32)
        return (x[:, self.cells].astype(np.float32) @ self.matrix) / size[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each row and the share of its margin, 0 to 1."""
        margin = 4 * (self.kernel(x) @ self.coefficients).astype(np.float64)
        share = np.exp(margin - margin.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(x)), best]


def train(languages: list[str], which: np.ndarray, x: np.ndarray, landmarks: int, ridge: float) -> Model:
    """Nyström map from evenly chosen landmarks, then ridge regression against +1 and -1 for each language."""
    marks = np.sort(np.concatenate([np.flatnonzero(which == k)[: max(OWN_MARKS, landmarks // len(languages))] for k in range(len(languages))]))
    model = Model(languages, x[marks].astype(np.int64), np.zeros((len(marks), len(languages))))
    inner = model.kernel(x[marks]).astype(np.float64)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    some = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, some] / np.sqrt(value[some])
    phi = np.concatenate([model.kernel(x[i : i + 512]) for i in range(0, len(x), 512)]).astype(np.float64) @ root
    target = np.where(which[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(which, minlength=len(languages))[which]  # languages count alike
    phi_w = phi * weight[:, None]
    solved = np.linalg.solve(phi_w.T @ phi + ridge * np.eye(phi.shape[1]), phi_w.T @ target)
    model.coefficients = (root @ solved).astype(np.float32)
    return model


def fit(spark: SparkSession, docs: DataFrame, n_train: int = 1600, landmarks: int = 96, ridge: float = 1e-3) -> Model | None:
    """Learn from text and lang of rows whose crc32 of the id modulo 3 is not 1."""
    usable = docs.where((common.remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # one row a language
    if not counts:
        return None
    each = max(LEAST, n_train // len(counts))
    # about 1.5 times as many pass by the hash of their id; the first of them are taken
    rate = spark.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["n"])) for r in counts], "lang string, rate double")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = usable.select("lang", "text", order.alias("order")).join(F.broadcast(rate), "lang").where("order < rate").where(F.regexp_like("text", F.lit(r"\p{L}")))
    sample = sample.groupBy("lang", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=1_000_000):
                for at in range(0, part.num_rows, ROWS):
                    some = part.slice(at, ROWS)
                    packed = np.packbits(presence(some.column(2)), axis=1)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "order", "bits"])

    # 4.3 kB each, about 1.5 times the sample
    rows = sample.select("lang", "order", "text").mapInArrow(vectors, "lang string, order double, bits binary").collect()
    rows.sort(key=lambda r: (r["order"], bytes(r["bits"])))
    languages, taken = sorted({r["lang"] for r in rows}), dict.fromkeys((r["lang"] for r in rows), 0)
    chosen = []
    for r in rows:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            chosen.append(r)
    if not chosen:
        return None
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:WIDTH] for r in chosen])
    return train(languages, np.array([languages.index(r["lang"]) for r in chosen]), x, landmarks, ridge)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns the model unless one is given."""
    model = model or fit(spark, docs)
    held_out = (common.remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            for part in common.slices(batch, limit=1_000_000):
                for at in range(0, part.num_rows, ROWS):
                    some = part.slice(at, ROWS)
                    best, share = model.predict(presence(some.column(1)))
                    letter = some.column(2).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(np.where(letter, share, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text", F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("letter"), held_out)
    return seen.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
