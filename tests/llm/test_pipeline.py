"""The pipeline stage by stage and as a whole: dedup and packing by brute force, the classifiers by columns and order."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from vetframe.llm import queries

from .test_nearcopies import slow_keep
from .test_tokens import LIBRARY

SF = "/root/testdata/sf0.001"


def bare(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    base = tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    sizes = [stages[n].count() for n in ["documents", *names[:-1]]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_exact_stage_by_brute_force(stages):
    before, after = (stages[n].collect() for n in ("quality", "exact_dedup"))
    best = {}
    for r in before:
        k = (-len(r["text"] or ""), r["doc_id"])
        best[bare(r["text"])] = min(best.get(bare(r["text"]), k), k)
    assert {r["doc_id"] for r in after} == {k[1] for k in best.values()} and len(after) == len(best)


def test_near_stage_keeps_one_of_each(stages):
    """Five-word shingle sets of all pairs, similarity of 0.8 or more."""
    before = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect()]
    assert sorted((r["doc_id"], r["text"]) for r in stages["near_dedup"].collect()) == slow_keep(before)


def test_run_packs_what_the_stages_keep(spark, stages):
    """The whole pipeline against the library's ids of the documents that are left, cut and placed."""
    got = corpus_pipeline.run(spark, SF).collect()
    want = Counter()
    for r in stages["near_dedup"].collect():
        ids = [*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            part = np.array(ids[start : start + 1024], "<u4")
            want[r["doc_id"], start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in places.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False)) and sum(rows[-1]) <= 1024


def test_packing_holds_what_stays(stages):
    pieces = stages["packing"].groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in stages["near_dedup"].collect()}


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


class Taken:
    """Stands for a DataFrame and gives the function that would run on its batches."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *names):
        return Taken(type(self.schema)([self.schema[n] for n in names]))

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_steps_take_little_memory():
    """Peak of what a worker of each stage holds over a batch of 4 MB: its arrays are those of a small step."""
    import random
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import types as T

    from vetframe.llm import nearcopies, packing, toxicity

    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    assert 3_500_000 < batch.nbytes < 5_000_000
    docs = Taken(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    model = toxicity.Model(np.arange(256) * 1000, np.zeros((3, 257), np.float32))
    for run in (toxicity.score(docs, model), packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0), nearcopies.spread(docs, 5, 100_000)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 48_000_000


def test_small_tables_need_no_python_worker(spark, monkeypatch):
    from vetframe.llm import common, components

    monkeypatch.setattr(common, "crowd", lambda rows: 3)
    monkeypatch.setattr(spark.sparkContext.__class__, "parallelize", None)
    rows = spark.range(40).selectExpr("IF(id < 10, NULL, id div 8) AS a", "id AS b")
    assert sorted(r["a"] or 0 for r in common.crowded_keys(rows, "a").collect()) == [0, 1, 2, 3, 4] and common.crowded_keys(rows, "b") is None
    edges = spark.range(1, 40).selectExpr("id div 8 AS a", "40 + id % 4 AS b")
    assert {r["label"] for r in components.components(spark, edges).collect()} == {0}
