"""BPE and packing: the library is the brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vetframe.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\t\rstmdrevl1a!é中\x85\xa0")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_encoder_equals_library(texts):
    e = bpe.Encoder(VOCABULARY)
    ids, at = e.encode(texts)
    for i, t in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == library(t)
        assert e.decode(mine).decode() == LIBRARY.decode(mine, skip_special_tokens=False)


def test_pair_tree_of_one_word():
    rnd, tree = random.Random(3), bpe.PairTree(VOCABULARY)
    for n in (1, 2, 3, 7, 64, 65, 500):
        word = "".join(rnd.choice("theandion") for _ in range(n))
        assert tree.encode(word.encode()) == library(word)
    assert tree.encode(b"") == []


def test_cache_is_forgotten_without_loss(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    e, rnd = bpe.Encoder(VOCABULARY), random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abcde") for _ in range(3)) for _ in range(30)) for _ in range(3)]
        ids, at = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library(t) for t in texts]


def test_digests_and_round_trip(docs, data):
    import hashlib

    want = sorted(((r[0] if r[0] is not None else -1), len(i := library(r[1] or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in data)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(docs, PATH).collect())
    assert got == want
    some = {r["doc_id"]: r for r in bpe.encode_documents(docs, PATH).collect()}
    assert some[3008]["ids"][0] == 50256 and some[3000]["ids"] == [] and some[3009]["decoded"] == data[-4][1]


def check_packing(spark, df, rows, capacity=1024):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*library(r[1] or ""), 0])
    got = packing.pack(spark, df, PATH, capacity, per_bucket=7).collect()
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]][(p["start"], p["length"], p["ids_crc32"], p["doc_tokens"])] += 1
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, texts in ids.items():
        want = Counter()
        for i in texts:
            for s in range(0, len(i), capacity):
                part = np.array(i[s : s + capacity], "<u4")
                want[(s, len(part), zlib.crc32(part.tobytes()), len(i))] += 1
        assert by_doc[d] == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence, sum(p["length"] for p in got)


def test_packing(spark, docs, data):
    sequences, total = check_packing(spark, docs, data)
    assert total / (1024 * len(sequences)) > 0.97


def test_packing_small_capacity_and_empty(spark, docs, data, empty):
    check_packing(spark, docs.where("doc_id < 40"), [r for r in data if r[0] is not None and r[0] < 40], 64)
    assert packing.pack(spark, empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_places_hold_every_piece_once(histogram):
    used, spaces = Counter(), defaultdict(list)
    for length, rank, count, sequence, offset in packing.shortest_pack_first(histogram, 64):
        for i in range(count):
            used[(length, rank + i)] += 1
            spaces[sequence + i].append((offset, length))
    assert used == Counter({(n, r): 1 for n, k in histogram.items() for r in range(k)})
    for s in spaces.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 64


def test_padding_against_full_lengths():
    rnd = random.Random(2)
    h = Counter(rnd.randint(1, 1024) for _ in range(20000))
    h[1024] += 5000
    entries = packing.shortest_pack_first(dict(h), 1024)
    n = max(s + c for _, _, c, s, _ in entries)
    assert sum(k * v for k, v in h.items()) / (1024 * n) > 0.98


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1024: 3}, {1: 5000}, {513: 10}])
def test_histogram_edges(histogram):
    entries = packing.shortest_pack_first(histogram, 1024)
    assert sum(c for _, _, c, _, _ in entries) == sum(histogram.values())


def doubling(n, a, b):
    """The word of length ``n`` that begins with ``a`` and doubles by its own complement."""
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_agree_modulo_powers_of_two(n):
    a, b = doubling(n, "a", "b"), doubling(n, "b", "a")
    e = bpe.Encoder(VOCABULARY)
    ids, at = e.encode([f"{a} {b}", f"{b} {a}"])
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [library(f"{a} {b}"), library(f"{b} {a}")]


def test_equal_hashes_of_unequal_words_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe.common.SpanHasher, "__call__", lambda self, units, start, end: (end - start).astype(np.uint64))
    e = bpe.Encoder(VOCABULARY)
    for texts in (["one two", "three"], ["six ten", "words", ""], ["one", "the"]):
        ids, at = e.encode(texts)
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [library(t) for t in texts]


def test_a_text_longer_than_a_step(spark):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(500_000))
    assert len(text) > 2 * bpe.STEP
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_digests(df, PATH).collect()}
    assert got == {1: len(library(text)), 2: len(library("short"))}


def test_digests_of_clashing_columns_and_of_nothing(clashing, empty, data):
    assert bpe.encode_digests(clashing, PATH).count() == packing.pack(clashing.sparkSession, clashing, PATH).select("doc_id", "start").where("start = 0").count() == len(data)
    assert bpe.encode_digests(empty, PATH).count() == 0
