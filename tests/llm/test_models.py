"""Classifiers by held-out accuracy, language models by identities, rules by brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetframe.llm import common, hmm, languageid, licences, quality, toxicity

from .conftest import INSULTS, SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def test_word_spans_and_hashes():
    texts = ["a b", "", None, "  cd\te", "f", " \n", "a"]
    raw, offsets = common.text_buffer(pa.array(texts))
    start, end, doc = common.word_spans(raw, offsets)
    assert [(int(d), raw[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    h = common.SpanHasher()(raw, start, end)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1


@pytest.mark.parametrize("part", [pa.array(["x", "ab", None]).slice(1), pa.array(["", None], pa.string()), pa.array([], pa.string()), pa.array(["ab", "c"], pa.large_string())])
def test_text_buffer(part):
    raw, offsets = common.text_buffer(part)
    assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [t or "" for t in part.to_pylist()]


@pytest.fixture(scope="module")
def scored(spark, docs, labels):
    return toxicity.toxicity(spark, docs, labels).collect()


def test_toxicity(scored, data):
    text = {r[0]: r[1] for r in data}
    assert len(scored) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in scored)
    held = [r for r in scored if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    right = [r["predicted"] == any(w in text[r["doc_id"]] for w in INSULTS) for r in held]
    assert len(held) > 30 and sum(right) / len(right) >= 0.95


def test_toxicity_drops_and_edges(spark, clashing, docs, labels, empty):
    out = toxicity.drop_toxic(spark, clashing, labels)
    assert out.columns == clashing.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert {i for i in range(240) if i % 8 and i in kept} == {i for i in range(240) if i % 8} and len([i for i in range(0, 240, 8) if i in kept]) <= 2
    none = toxicity.toxicity(spark, docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(spark, empty, labels).count() == 0


def test_nnpu_risk_stays_non_negative_and_finds_positives():
    rng = np.random.default_rng(0)
    p = (rng.random((300, 6)) < [0.9, 0.6, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    hidden = (rng.random(2000) < 0.2)
    u = (rng.random((2000, 6)) < np.where(hidden[:, None], [0.9, 0.6, 0.1, 0.1, 0.1, 0.1], [0.02, 0.02, 0.1, 0.1, 0.1, 0.1])).astype(np.float32)
    w = toxicity.train_nnpu(p, u, 0.2, 0)
    predicted = u @ w[:-1] + w[-1] > 0
    assert (predicted == hidden).mean() > 0.95


def test_languages(spark, docs, data, empty):
    lang = {r[0]: (r[1], r[2]) for r in data}
    got = languageid.identify(spark, docs).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in got)
    for r in got:
        if not any(c.isalpha() for c in lang[r["doc_id"]][0] or ""):
            assert r["lang_pred"] == "und"
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][1] for r in held) / len(held) >= 0.97
    assert languageid.identify(spark, empty).count() == 0
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in languageid.identify(spark, nothing).collect()] == [("und", 0.0)]


def test_presence_is_the_set_of_grams():
    a, b, c = languageid.presence(pa.array(["abab", "ab", None]))
    assert a.sum() > b.sum() > 0 and c.sum() == 0 and ((b == 1) <= (a == 1)).all()
    one, two = languageid.presence(pa.array(["abc", "xyz"])), languageid.presence(pa.array(["abc"]))
    assert (one[0] == two[0]).all()  # no gram crosses from one text to the next


def test_hmm_base_and_model(spark, docs, data, empty):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [(r[0], WORD.findall(low(r[1]))) for r in data]
    counts = Counter()
    for d, w in words:
        if remainder(d, 7) != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    got = defaultdict(list)
    for r in hmm.score_documents(spark, docs).collect():
        got[r["doc_id"]].append(r)
    held = [0.0, 0.0]
    for d, w in words:
        r = got[d][0]
        if len(got[d]) == 1 or len({x["n_tokens"] for x in got[d]}) == 1:
            tokens = [*w, None]
            base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, remainder(d, 7) == 2)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] <= 0 and math.isfinite(r["score"])
            if r["held_out"]:
                held[0] += r["base_score"]
                held[1] += r["score"]
    assert held[1] > held[0]
    assert hmm.score_documents(spark, empty).count() == 0


def test_no_training_document(spark):
    ids = [i for i in range(40) if remainder(i, 7) == 2]
    got = hmm.score_documents(spark, spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")).collect()
    assert len(got) == len(ids) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}


def test_forward_equals_enumeration():
    model = hmm.Hmm(np.ones(hmm.CLASSES))
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 9, 30):
        seq = rng.integers(0, hmm.CLASSES, n)
        a = model.start * model.emit[:, seq[0]]
        for o in seq[1:]:
            a = (a @ model.move) * model.emit[:, o]
        assert abs(model.log10_probability([seq, seq[:1]])[0] - math.log10(a.sum())) < 1e-9
    assert abs(model.emit.sum() - hmm.STATES) < 1e-9 and abs(model.move.sum() - hmm.STATES) < 1e-9


def test_expected_counts_add_up():
    model = hmm.Hmm(np.ones(hmm.CLASSES))
    rng = np.random.default_rng(2)
    lengths = np.array([1, 5, 128, 129, 300])
    classes = rng.integers(0, hmm.CLASSES, lengths.sum())
    total = model.expected(classes, lengths)
    k = hmm.STATES
    segments = sum(-(-int(n) // hmm.SEGMENT) for n in lengths)
    assert abs(total[:k].sum() - len(lengths)) < 1e-3 and abs(total[k : k + k * k].sum() - (lengths.sum() - segments)) < 0.05
    assert np.allclose(total[k + k * k :].reshape(k, -1).sum(0), np.bincount(classes, minlength=hmm.CLASSES), atol=1e-3)


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def slow_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def test_quality(spark, data, empty):
    phrase = "one two three four five six seven eight nine ten"
    more = [(4000, f"{phrase} x {phrase} y " + " ".join(f"w{i}" for i in range(50)), "xx", "s", 0), (4001, " ".join([phrase] * 6), "xx", "s", 0), (4002, "q " * 40 + "\n" + "q " * 40, "xx", "s", 0)]
    more += [(4003, " ".join(f"{w}%%%" for w in data[1][1].split()), "xx", "s", 0), (4004, " | ".join(f"zork{i}" for i in range(120)), "xx", "s", 0)]
    every = [*data, *more]
    df = spark.createDataFrame(every, SCHEMA)
    got = defaultdict(list)
    for r in quality.quality(df).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(every)
    for d, t, *_ in every:
        want = slow_counts(t)
        assert any((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want for r in got[d]), (d, want, got[d])
        assert all(not (r["kept"] and r["base_failed"]) for r in got[d])
    assert all(got[i][0]["kept"] for i in range(240)) and not got[4003][0]["kept"] and not got[4004][0]["kept"]
    refs = quality.References(df)
    for d in (3, 4, 5, 4004):
        words = WORD.findall(next(t for i, t, *_ in every if i == d))
        n = len(words)
        c = [sum(w.lower() == x for w in words) for x in refs.words]
        p = [x / n for x in [*c, n - sum(c)]]
        assert abs(min(slow_distance(p, q) for q in refs.shares) - got[d][0]["word_distance"]) < 1e-9
    assert quality.quality(empty).count() == 0


def test_quality_filter(clashing, empty):
    out = quality.drop_poor(clashing)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == clashing.columns and set(range(240)) <= kept and 3003 not in kept and quality.drop_poor(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("Words.\nReleased under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("x. This work is licensed under the GNU General Public License, version 3.", ["GPL-3"]),
        ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at some place.", ["Apache-2.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies.", ["MIT"]),
        ("Copyright 2020 Someone. All rights reserved.", ["all-rights-reserved"]),
        ("Released under the MIT License.\nReleased under the MIT License.", ["MIT"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["SPDX-bsd-3-clause"]),
        ("Nothing to see here.", []),
        ("", []),
    ],
)
def test_licences(text, licenses):
    assert licences.scan_text(text)[2] == licenses


def test_cues_skip_nothing(data):
    """A text without a cue has no known license sentence."""
    for _, t, *_ in data:
        if t and not any(c in t.lower() for c in licences.CUES):
            assert not any(licences.identify(licences.normalise(s)) for s in re.split(r"(?<=[.!?])\s+|[\r\n]+", t))


def test_licence_rows(spark, docs, data, empty):
    got = licences.scan(docs)
    assert got.count() == len(data) and licences.scan(empty).count() == 0
    assert licences.scan_text("The licence of this is odd.")[3] == 1


def test_rows_are_stable():
    assert rows(1) == rows(1)


def test_common_words_lie_above_a_count(spark):
    counts = spark.createDataFrame([(h, c) for h, c in enumerate([1] * 50 + [3] * 20 + [9] * 5 + [500])], "h long, c long")
    for most, n in ((0, 0), (5, 1), (6, 6), (30, 26), (76, 76)):
        assert hmm.most_frequent(counts, most).count() == n
    assert hmm.most_frequent(counts.limit(0), 10).count() == 0


def test_first_ids_are_those_of_the_whole_sort(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    whole = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(200).collect()
    assert toxicity.first_ids(ids, 5000, 200).collect() == whole
    assert toxicity.first_ids(ids, 5000, 9000).count() == 5000
    assert toxicity.first_ids(ids.limit(0), 0, 10).count() == 0


def test_each_training_token_counts_once_and_partitions_do_not_matter(spark, docs, data):
    marked = docs.select("doc_id", "text", (common.remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    lexicon = hmm.Lexicon(spark, marked.where("NOT held_out"))
    table = hmm.sequences(marked, lexicon)
    _, counts = hmm.train(table, lexicon)
    tokens = sum(len(WORD.findall(r[1] or "")) + 1 for r in data if remainder(r[0], 7) != 2)
    k = hmm.STATES
    assert lexicon.tokens == tokens and abs(counts[k + k * k :].sum() - tokens) < 1e-3 * tokens / 100
    two, nine = (sorted((str(r["doc_id"]), r["score"]) for r in hmm.score_documents(spark, docs.repartition(n)).collect()) for n in (2, 9))
    assert [d for d, _ in two] == [d for d, _ in nine] and max(abs(a - b) for (_, a), (_, b) in zip(two, nine, strict=True)) < 1e-2


def test_copies_of_an_id_do_not_fill_the_samples(spark, docs, labels):
    copies = spark.range(2000).selectExpr("1L AS doc_id", "concat('copy ', id) AS text", "'xx' AS lang", "'s' AS source", "0L AS n_chars")
    more = docs.unionByName(copies)
    model = toxicity.fit(spark, more, labels.unionByName(spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")), n_positive=40, n_unlabelled=60)
    assert model.weights is not None
    ids = toxicity.first_ids(more.where("doc_id IS NOT NULL").select("doc_id"), 300, 60)
    assert ids.count() == ids.distinct().count() == 60
    assert languageid.fit(spark, more).languages == ["xx", "yy", "zz"]


def test_every_language_is_learnt(spark):
    rows = [(1000 * k + i, " ".join(chr(0x4E00 + 50 * k + (i * j) % 40) * 2 for j in range(30)), f"l{k}") for k in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in languageid.identify(spark, df).collect()}
    assert len(languageid.fit(spark, df).languages) == 30 and sum(got[d] == lang for d, _, lang in rows) > 0.9 * len(rows)
