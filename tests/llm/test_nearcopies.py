"""The near-copy stage against all pairs of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vetframe.llm import common, nearcopies

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_keep(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    best = {}
    for k, (d, _) in zip(label, rows, strict=True):
        best[k] = min(best.get(k, (True, 0)), (d is None, d or 0))
    return sorted((d, t) for k, (d, t) in zip(label, rows, strict=True) if best[k] == (d is None, d or 0))


def family(rnd, base, changes):
    words = base.split()
    for at in rnd.sample(range(len(words)), changes):
        words[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_stage_takes_near_copies_of_08_and_no_others(spark):
    rnd, rows = random.Random(3), []
    for i in range(40):
        base = " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(60, 400)))
        rows += [(100 * i + k, family(rnd, base, round(len(base.split()) * share))) for k, share in enumerate((0, 0.01, 0.02, 0.03, 0.06, 0.2))]
    got = corpus_pipeline.remove_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = slow_keep(rows)
    assert sorted(map(tuple, got)) == want and 40 < len(want) < len(rows) - 40


def test_a_pair_far_apart_in_fingerprints_goes(spark):
    """5-word similarity of 0.83 at nine bits of difference: documents 1 and 177 of the given table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 177, 2)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect()) == [1, 2]


def test_ids_that_repeat_or_are_null(spark):
    rnd = random.Random(4)
    a, b, c = (" ".join(f"w{rnd.randrange(4000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, family(rnd, a, 1)), (2, b), (None, c), (None, family(rnd, c, 1)), (9, "Few words"), (8, "few  words")]
    got = {(r["doc_id"], r["text"]) for r in nearcopies.keep_one(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(1, a), (2, b), (8, "few  words")} <= got and len(got) == 4 and sum(d is None for d, _ in got) == 1
    assert nearcopies.keep_one(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_sets_of_many_classes_and_parts(spark, monkeypatch):
    """Families that bands tie together without being near copies, in small parts and with few pivots."""
    from vetframe.llm import common

    monkeypatch.setattr(common, "crowd", lambda rows: 7)
    monkeypatch.setattr(nearcopies, "PIVOTS", 2)
    monkeypatch.setattr(nearcopies, "HELD", 9_000)
    rnd, rows = random.Random(11), []
    base = " ".join(f"w{rnd.randrange(4000)}" for _ in range(200))
    heads = [family(rnd, base, 6) for _ in range(12)]
    for i, head in enumerate(heads):
        rows += [(100 * i + k, family(rnd, head, k)) for k in range(4)]
    got = nearcopies.keep_one(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = slow_keep(rows)
    assert sorted(map(tuple, got)) == want and 3 < len(want) < 40


def test_columns_that_clash(clashing):
    assert nearcopies.keep_one(clashing.sparkSession, clashing).columns == clashing.columns


def slow_labels(n, links):
    label = list(range(n))
    for i, j in links:
        label = [label[i] if k == label[j] else k for k in label]
    return [label.index(k) for k in label]


def test_words_of_the_fingerprint_are_majorities():
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, n, dtype=np.uint64)) for i, n in enumerate((1, 2, 5, 300, 700))]
    got = nearcopies.fingerprint_words(np.concatenate(sets), np.array([len(x) for x in sets]), 3, 5)

    def mixed(h, word):
        x = (int(h) + (word + 1) * common.MULTIPLIER) % 2**64
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % 2**64
        return x ^ x >> 33

    for i, s in enumerate(sets):
        for word in (3, 4):
            x = [mixed(h, word) for h in s]
            assert int(got[i, word - 3]) == sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in x) > len(x))


@pytest.mark.parametrize("crowd, many, compared", [(1 << 17, 1 << 20, 3), (60, 1 << 20, 12), (1 << 17, 30, 12), (60, 30, 3)])
def test_candidates_are_the_rows_that_meet_at_anchors(spark, monkeypatch, crowd, many, compared):
    """The near-copy stage's candidates against all pairs of SimHash fingerprints; in parts, and by pivots."""
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    monkeypatch.setattr(nearcopies, "MANY", many)
    monkeypatch.setattr(nearcopies, "SHARE", 1)
    monkeypatch.setattr(nearcopies, "CHUNK", 20)
    rnd, texts = random.Random(5), ["", "a b c d e f g h", "a b c d e f g h i", "one two"]
    for _ in range(25):
        base = " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(12, 150)))
        texts += [family(rnd, base, round(len(base.split()) * share)) for share in (0, 0.02, 0.05, 0.1, 0.2)]
    texts += [texts[9]] * 90 + [family(rnd, texts[9], 1) for _ in range(30)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    links = [tuple(r) for r in nearcopies.ties(nodes, 5, len(texts), compared).collect()]

    sets = nearcopies.distinct_hashes(*nearcopies.shingle_hashes(pa.array(texts), common.SpanHasher(), 5))
    size, (free, usual, few) = np.array([len(x) for x in sets]), nearcopies.plan(len(texts))
    width = 15 + free
    per = 64 // width
    words = nearcopies.fingerprint_words(np.concatenate(sets), size, 0, nearcopies.BLOCKS + -(-few // per))
    differ = np.bitwise_count(words[:, None, :compared] ^ words[None, :, :compared]).sum(2)
    usually, seldom = (nearcopies.apart(compared, p) for p in (nearcopies.DIFFER, nearcopies.DIFFER_FEW))
    met, near = np.zeros(differ.shape, bool), differ <= np.where((size[:, None] <= 5) & (size <= 5), seldom, usually)
    for block in range(few):
        x = (words[:, nearcopies.BLOCKS + block // per] >> np.uint64(block % per * width)) & np.uint64((1 << width) - 1)
        apart = x[:, None] ^ x[None, :]
        mine = (size <= 5) | (block < usual)
        met |= (apart >> np.uint64(15) == 0) & (np.bitwise_count(apart) <= 1) & mine[:, None] & mine & (differ <= (usually if block < usual else seldom))
    least, reached = (slow_labels(len(texts), x) for x in (np.argwhere(met).tolist(), links))
    assert all(near[a, b] or least[a] == least[b] for a, b in links)
    # a task may also link rows that are two bits apart: replicas at one anchor are compared with homes only
    assert len(set(least)) > 30 and all(reached[i] == reached[least[i]] for i in range(len(texts)))


def test_enough_blocks_for_sets_of_any_size():
    """The chance to miss, from the exact chance that a bit differs, for sets of up to 40 shingles at 0.8 and more."""
    from math import comb

    def differ(c, a, b):
        one = lambda s, own, n: sum(comb(own, i) for i in range(own + 1) if 2 * (s + i) > n) / 2**own
        both = [(comb(c, s) / 2**c, one(s, a - c, a), one(s, b - c, b)) for s in range(c + 1)]
        return sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in both)

    for rows in (100, 200_000, 10**7):
        free, usual, few = nearcopies.plan(rows)
        for union in range(2, 41):
            for common_ in range(-(-8 * union // 10), union):
                for a in range(common_, (union + common_) // 2 + 1):
                    b = union + common_ - a
                    p = differ(common_, a, b)
                    met = (1 - p) ** free * ((1 - p) ** 15 + 15 * p * (1 - p) ** 14)
                    assert (1 - met) ** (few - usual if b <= nearcopies.FEW else usual) <= 5e-6
