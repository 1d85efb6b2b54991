"""Exact and near copies, sharding: against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetframe.llm import bloom, components, exactdedup, sharding, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]")


def bare(text):
    return hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()


def test_exact_marks(spark, docs, data):
    groups = defaultdict(list)
    for r in data:
        groups[bare(r[1])].append((-len(r[1] or ""), r[0] if r[0] is not None else 1 << 62))
    got = exactdedup.mark_duplicates(spark, docs).collect()
    assert len(got) == len(data)
    for r in got:
        g = sorted(groups[r["text_sha256"]])
        assert r["group_size"] == len(g) and (r["keep_id"] if r["keep_id"] is not None else 1 << 62) == g[0][1]
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1)) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_keeps_columns(spark, clashing, data, empty):
    out = exactdedup.deduplicate(spark, clashing)
    assert out.columns == clashing.columns and Counter(bare(r["text"]) for r in out.collect()) == Counter(dict.fromkeys({bare(r[1]) for r in data}, 1))
    assert exactdedup.mark_duplicates(spark, empty).count() == 0 and exactdedup.deduplicate(spark, empty).count() == 0


def test_a_full_filter_changes_nothing(spark, docs, monkeypatch):
    right = sorted(map(str, exactdedup.mark_duplicates(spark, docs).drop("kept").collect()))
    monkeypatch.setattr(bloom, "filter_bits", lambda rows: 64)
    assert sorted(map(str, exactdedup.mark_duplicates(spark, docs).drop("kept").collect())) == right


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(3000).withColumn("k", F.col("id") % 2000)
    bits = bloom.filter_bits(3000)
    twice = bloom.probe(keys, bloom.bitmaps(keys, ["k"], bits, least=2), ["k"], bits).where("k < 1000")
    assert twice.where("NOT maybe").count() == 0
    other = spark.range(100_000, 103_000).withColumnRenamed("id", "k")
    assert bloom.probe(other, bloom.bitmaps(keys, ["k"], bits), ["k"], bits).where("maybe").count() < 300


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fp, distance=4):
    parent = {x: x for x in fp}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every = list(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                parent[find(a)] = find(b)
    return {x: find(x) for x in every}


def test_near_duplicates(spark, docs, data):
    prints = [(r[0], slow_fingerprint(r[1])) for r in data]
    classes = slow_classes({f for _, f in prints})
    least = defaultdict(lambda: 1 << 62)
    for d, f in prints:
        if d is not None:
            least[classes[f]] = min(least[classes[f]], d)
    want = sorted((-1 if d is None else d, f"{f:016x}", -1 if d is None and least[classes[f]] == 1 << 62 else least[classes[f]]) for d, f in prints)
    got = simhash.near_duplicates(spark, docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert len({r["component_id"] for r in got if r["doc_id"] is not None and 2000 <= r["doc_id"] < 3000}) == 1


def test_majority_over_255_shingles():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 255, 256, 700, 0, 3])
    h = rng.integers(0, 1 << 63, counts.sum(), np.uint64)
    out, at = simhash.majority(h, counts), 0
    for n, got in zip(counts, out, strict=True):
        some = h[at : at + n]
        at += n
        assert int(got) == sum(1 << b for b in range(64) if 2 * int(((some >> np.uint64(b)) & np.uint64(1)).sum()) > n)


@pytest.mark.parametrize("blocks", [simhash.NARROW, simhash.WIDE])
def test_code_covers_and_replicas_reach(blocks):
    nearest, second = simhash.hamming_code()
    code = set(nearest.tolist())
    assert len(code) == 2048 and all(bin(w ^ int(c)).count("1") <= 1 for w, c in enumerate(nearest))
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, np.uint64)
    for d in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, d, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        kx, rx, hx = simhash.anchors(x, nearest, second, blocks)
        ky, ry, _ = simhash.anchors(y, nearest, second, blocks)
        homes, reach = set(zip(kx[hx].tolist(), rx[hx].tolist(), strict=True)), set(zip(ky.tolist(), ry.tolist(), strict=True))
        assert {r for _, r in homes & reach} == set(range(400))


@pytest.mark.parametrize(("crowd", "many", "held"), [(4096, 1 << 28, 50_000), (8, 1 << 28, 20), (4096, 1, 50_000)])
def test_links_of_dense_and_random_fingerprints(spark, crowd, many, held, monkeypatch):
    for name, value in (("CROWD", crowd), ("MANY", many), ("HELD", held)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(4)
    values = set(rng.integers(0, 1 << 63, 150, np.uint64).tolist())
    centre = 0x123456789ABCDEF0
    for _ in range(120):  # a crowd around one value, and chains
        v = centre
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {(1 << (3 * i)) - 1 for i in range(21)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    edges = simhash.links(spark, spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    pairs = edges.collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in pairs) and len(pairs) < 40 * len(values)
    labels = {r["node"] & (2**64 - 1): r["label"] & (2**64 - 1) for r in components.components(spark, edges).collect()}
    mine, right = defaultdict(set), defaultdict(set)
    for v, c in slow_classes(values).items():
        right[c].add(v)
        mine[labels.get(v, v)].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, right.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = dict(components.components(spark, edges).collect())
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_keep_one(spark, clashing, data, empty):
    out = simhash.keep_one(spark, clashing)
    marks = simhash.near_duplicates(spark, clashing)
    want = {r["component_id"] for r in marks.collect() if r["component_id"] is not None}
    assert out.columns == clashing.columns and {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == want
    assert simhash.keep_one(spark, empty).count() == 0 and simhash.near_duplicates(spark, empty).count() == 0


def brute_minimax(sizes, k):
    """The smallest largest shard over all contiguous cuts, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(1, len(ends))]
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 9))
def test_plan_is_minimax(sizes, k, seed):
    names = sorted(hashlib.sha256(f"{seed}-{i}".encode()).hexdigest() for i in range(len(sizes)))
    of = dict(zip(names, sizes, strict=True))

    def ranges(some, digits):
        found = defaultdict(list)
        for n in some:
            found[n[:digits]].append(of[n])
        return [sharding.Range(p, sum(s), len(s), max(s)) for p, s in found.items()]

    def split(prefixes):
        return [r for p in prefixes for r in ranges([n for n in names if n.startswith(p)], len(p) + 1)]

    capacity, begins = sharding.plan(ranges(names, 0), k, split)
    assert capacity == brute_minimax(sizes, k)
    loads = Counter()
    for n in names:
        loads[sum(n >= b for b in begins)] += of[n]
    assert max(loads.values()) == capacity and len(begins) < k


def test_shards(spark, docs, clashing, data, empty):
    got = sharding.shard(spark, clashing, 4, per_slot_bucket=9).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    groups = defaultdict(int)
    for r in data:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()] += len((r[1] or "").encode()) + 1
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(loads.values()) == brute_minimax([groups[g] for g in sorted(groups)], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in got} == {"bytes"}
    assert sharding.shard(spark, empty).count() == 0


def test_one_group_holds_most(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(20)]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 300}) == 1 and len(got) == 320


def test_ids_of_text(spark):
    rows = [("b", "one two"), ("a", "onetwo"), (None, "one  two"), ("c", "other")]
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exactdedup.mark_duplicates(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", None, False), ("a", None, False), (None, None, True), ("c", "c", True)}


def test_crowded_groups(spark, monkeypatch):
    from vetframe.llm import common

    monkeypatch.setattr(common, "crowd", lambda rows: 3)
    rows = [(i, "same words here") for i in range(40)] + [(100, "same  words here"), (101, "another text"), (102, "anothertext")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = exactdedup.mark_duplicates(spark, df).collect()
    assert len(got) == 43 and {r["doc_id"] for r in got if r["kept"]} == {100, 101} and {r["group_size"] for r in got if r["doc_id"] < 101} == {41}
    assert {r["doc_id"] for r in exactdedup.deduplicate(spark, df).collect()} == {100, 101}
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(59, 60), (61, 62)], "a bigint, b bigint")
    assert dict(components.components(spark, edges).collect()) == {**dict.fromkeys(range(61), 0), 61: 61, 62: 61}
    assert {r["component_id"] for r in simhash.near_duplicates(spark, df).where("doc_id < 101").collect()} == {0}


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (2, "something else that is quite another text")]
    got = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], rows[2]])


def test_thinned_edges(spark):
    """Many links a node become about one, also at a node that is crowded; the components stay."""
    pairs = [(x, y) for y in range(5000, 5020) for x in range(0, 9000, 3) if x != y]
    edges = spark.createDataFrame([*pairs, *pairs[:50], (20_001, 20_000), (7, 7)], "a bigint, b bigint")
    nodes = {n for pair in pairs for n in pair}
    stars = components.thinned(edges)
    assert stars.count() < 2 * len(nodes) and stars.where("a >= b").count() == 0
    assert dict(components.components(spark, edges).collect()) == {**dict.fromkeys(nodes, 0), 20_000: 20_000, 20_001: 20_000}
    assert components.components(spark, edges.limit(0)).count() == 0
