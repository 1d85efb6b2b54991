"""Boundaries of every threshold, and operators against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vetframe import vocab
from vetframe.functions import bits, geometry, names
from vetframe.operators import apply, classes, duplicates, findings, inject, manifest, resplit, rows

BOX = "key string, split string, line_no int, cls int, xc double, yc double, w double, h double"


def boxes(spark, values):
    return spark.createDataFrame([(f"train/{i}", "train", 1, 0, *v) for i, v in enumerate(values)], BOX)


def held(df, check):
    return [r["v"] for r in df.withColumn("v", check).orderBy(F.expr("cast(split(key, '/')[1] as int)")).collect()]


def test_vocabulary_is_closed():
    assert len(vocab.SEVERITY) == 32 and {k.category for k in vocab.kinds() if k.type in vocab.GOVERNANCE} == {"governance"}
    assert [sum(s == x for s in vocab.SEVERITY.values()) for x in vocab.SEVERITIES] == [11, 15, 6]


def test_degenerate_and_tiny(spark):
    df = boxes(spark, [(0.5, 0.5, w, 0.5) for w in (0.0, 1e-9, 1.1e-9, 0.0029, 0.003, 0.0031)] + [(0.5, 0.5, 0.003, 0.003)])
    assert held(df, rows.degenerate()) == [True, True, False, False, False, False, False]
    assert held(df, rows.tiny()) == [False, False, True, True, False, False, True]


def test_out_of_bounds(spark):
    df = boxes(spark, [(0.5, 0.5, 1.0, 1.0), (0.5, 0.5, 1.0 + 1e-9, 1.0), (0.5, 0.5, 1.0 + 1e-7, 1.0), (-0.1, 0.5, 0.0, 0.1), (0.97, 0.5, 0.2, 0.1)])
    assert held(df, rows.out_of_bounds()) == [False, False, True, True, True]


def test_undetectable_and_class_range(spark):
    df = boxes(spark, [(0.5, 0.5, w, 0.5) for w in (0.0, 8 / 640 - 1e-6, 8 / 640)])
    assert held(df, rows.undetectable(640)) == [False, True, False]
    df = spark.createDataFrame([("t/0", 1, c) for c in (-1, 0, 2, 3)], "key string, line_no int, cls int")
    assert df.where(rows.class_out_of_range(3)).count() == 2 and df.where(rows.class_out_of_range(0)).count() == 1


def test_whole_frame_gate(spark):
    few = boxes(spark, [(0.5, 0.5, 0.98, 0.98)] * 4)
    enough = boxes(spark, [(0.5, 0.5, 0.98, 0.98)] * 5 + [(0.5, 0.5, 0.979, 1.0)])
    rare = boxes(spark, [(0.5, 0.5, 0.98, 0.98)] * 5 + [(0.5, 0.5, 0.1, 0.1)] * 246)
    assert [rows.whole_frame_hits(x).count() for x in (few, enough, rare)] == [0, 5, 0]


def test_repeats(spark):
    df = spark.createDataFrame([("a", "train", n, 0, 0.5, 0.5, w, 0.1) for n, w in ((1, 0.2), (2, 0.2000000001), (3, 0.3), (7, 0.2))], BOX)
    assert [(r["line_no"], r["first_line"]) for r in rows.repeats(df).orderBy("line_no").collect()] == [(2, 1), (7, 1)]
    assert apply.dedupe(df).count() == 2


def test_denormalised(spark):
    images = spark.createDataFrame([(k, 640, 480) for k in "abcd"], "key string, width int, height int")
    px = [("a", 320.0), ("a", 0.5), ("a", 0.5), ("b", 320.0), ("b", 0.5), ("b", 0.5), ("b", 0.5), ("c", 1.5), ("d", 640 * 1.03)]
    df = spark.createDataFrame([(k, "train", i, 0, v, 0.5, 0.1, 0.1) for i, (k, v) in enumerate(px)], BOX)
    assert {r["key"] for r in rows.denormalised(df, images).collect()} == {"a"}


def square(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def crossing(p) -> bool:
    """Every pair of edges that share no vertex, directly."""
    turn = lambda a, b, c: (v > 1e-12) - (v < -1e-12) if (v := (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) is not None else 0
    n = len(p)
    for i in range(n):
        for j in range(i + 1, n):
            if j - i in (1, n - 1):
                continue
            a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return True
    return False


def test_polygons(spark):
    rnd = random.Random(5)
    shapes = [square((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)), square((0.2, 0.2), (0.8, 0.8), (0.8, 0.2), (0.2, 0.8)), square((0.1, 0.1), (0.3, 0.3), (0.5, 0.5)), square((0, 0), (1, 1))]
    shapes += [square(*((rnd.random(), rnd.random()) for _ in range(rnd.randint(3, 9)))) for _ in range(60)]
    shapes += [square(*((i, i % 2) for i in range(n))) for n in (160, 161)]
    df = spark.createDataFrame([(f"k{i:03}", 1, s) for i, s in enumerate(shapes)], "key string, line_no int, polygon array<struct<x:double,y:double>>")
    got = {(r["key"], r["type"]) for r in rows.row_hits(df, rows.polygon_checks()).collect()}
    assert ("k001", "polygon_self_intersecting") in got and ("k002", "polygon_zero_area") in got and ("k003", "polygon_too_few_points") in got
    assert not [t for k, t in got if k == "k000"]
    assert {k for k, t in got if t == "polygon_unverified"} == {f"k{len(shapes) - 1:03}"}
    for i, s in enumerate(shapes[:-1]):
        assert ((f"k{i:03}", "polygon_self_intersecting") in got) == crossing(s), s


def test_keypoints(spark):
    points = [{"x": 0.5, "y": 0.5, "v": v} for v in (0.0, 1.0, 2.0, 0.5)] + [{"x": 0.62, "y": 0.5, "v": 2.0}, {"x": 0.6201, "y": 0.5, "v": 2.0}, {"x": 0.9, "y": 0.5, "v": 0.0}]
    df = spark.createDataFrame([("a", 1, 0.5, 0.5, 0.2, 0.2, points)], "key string, line_no int, xc double, yc double, w double, h double, keypoints array<struct<x:double,y:double,v:double>>")
    assert {(r["type"], r["point"]) for r in rows.keypoint_hits(df).collect()} == {("keypoint_visibility_invalid", 3), ("keypoint_outside_box", 5)}


@pytest.mark.parametrize("seed", range(4))
def test_hamming_join_loses_no_pair(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(120)]
    for _ in range(40):
        v = rnd.choice(base)
        for b in rnd.sample(range(64), rnd.randint(0, 6)):
            v ^= 1 << b
        base.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in base]
    images = spark.createDataFrame([(f"k{i:03}", h) for i, h in enumerate(signed)] + [("none", None)], "key string, hash bigint")
    key = lambda df: sorted((r["l"], r["r"], r["d"]) for r in df.collect())
    assert key(duplicates.hamming_pairs(images)) == key(duplicates.all_pairs(images))
    with pytest.raises(ValueError):
        duplicates.hash_links(images, 5, bands=5)


def test_links_of_any_number_of_bands(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(60) for _ in range(60)]
    base += [rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(60), rnd.randint(0, 6))) for _ in range(120)]
    images = spark.createDataFrame([(f"k{i:03}", h) for i, h in enumerate(base)], "key string, hash bigint")
    want = sorted((a, b, (a ^ b).bit_count()) for a in set(base) for b in set(base) if a < b and (a ^ b).bit_count() <= 5)
    for bands in (None, 6, 7, 8):
        assert sorted(map(tuple, duplicates.hash_links(images, bands=bands, bits=60).collect())) == want


def test_pairs_to_compare_follow_the_hashes():
    for n in (50_000, 500_000, 3_000_000, 30_000_000):
        m = duplicates.band_count(n, 5, 60)
        kept = list(combinations(bits.widths(m, 60), m - 5))
        assert len(kept) <= 126 and sum(n / 2 / 2 ** sum(k) for k in kept) < 300  # rows to join and pairs to compare, a hash
    assert duplicates.band_count(1_000, 5, 60) == 6


def hashed_once(spark, how):
    """Rows of ``how`` over images whose hashes count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def slow(h):
        made.add(1)
        return h

    data = [("train/a", "train", "x", 7), ("train/b", "train", "y", 7), ("val/c", "val", "x", 15), ("val/d", "val", "y", 0xFFFFF << 30), ("val/e", "val", "x", 1 << 50 | 0xFFF)]
    images = spark.createDataFrame(data, "key string, split string, source string, h bigint").withColumn("hash", F.udf(slow, "bigint")("h"))
    rows = sorted(map(tuple, how(images).collect()))
    assert made.value == 2 * len(data) or made.value == len(data), made.value  # once a row; a filter on the hash may repeat it
    return rows


def test_near_within_split_hashes_once(spark):
    assert hashed_once(spark, duplicates.near_within_split) == [("train/a", "train"), ("train/b", "train")]


def test_across_sources_hashes_once(spark):
    assert hashed_once(spark, duplicates.across_sources) == [("train/a", "x", True), ("train/b", "y", True), ("val/c", "x", False)]


def test_components_hash_once(spark):
    got = hashed_once(spark, lambda images: duplicates.components(spark, images))
    assert got == [("train/a", "train/a"), ("train/b", "train/a"), ("val/c", "train/a"), ("val/d", "val/d"), ("val/e", "val/e")]


def test_leakage_hashes_once(spark):
    assert hashed_once(spark, duplicates.leakage) == [("val/c",)]


def test_proposal_is_written_as_it_goes(spark, monkeypatch):
    made, rnd = spark.sparkContext.accumulator(0), random.Random(3)

    def counted(size):
        made.add(1)
        return size

    data = [(f"g{i:03}", rnd.choice((1, 1, 1, 2, 9)), sorted(rnd.sample(range(9), rnd.randint(0, 2)))) for i in range(200)]
    grouped = spark.createDataFrame(data, "group_key string, size long, classes array<int>").withColumn("size", F.udf(counted, "bigint")("size"))
    monkeypatch.setattr(resplit, "CHOSEN", 7, raising=False)
    held, seen, want, target = 0, set(), {}, round(sum(g[1] for g in data) * 0.2)
    for key, size, cls in sorted(data, key=lambda g: (-g[1], g[0])):
        val = held + size <= target or bool(set(cls) - seen) and held + size < 1.5 * target
        held, seen = held + size * val, seen | set(cls) if val else seen
        want[key] = "val" if val else "train"
    assert dict(resplit.propose(spark, grouped).collect()) == want
    assert made.value == len(data)


def test_text_hashes_of_repeated_and_odd_rows(spark, tmp_path):
    import duckdb

    from vetframe import adapters, queries

    odd = [(1, "One two\tthree", "a"), (1, "two four\x0bfive\r\nsix", "b"), (2, "", "a"), (3, None, "a"), (4, " \n ", "b"), (5, "Ünï  cödé x", "a"), (6, "tie two", "a"), (None, "no id", "b"), (7, "w " * 5000 + "v", "b")]
    spark.createDataFrame(odd, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"WITH {queries.HASHES} SELECT doc_id, source, hash FROM hashes").fetchall()
    got = [tuple(r) for r in adapters.text_hashes(spark, str(tmp_path)).select("doc_id", "source", "hash").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bands_cover_all_bits():
    assert bits.widths(6) == [11, 11, 11, 11, 10, 10] and sum(w for _, w in bits.masks(6)) == 64


def test_components_and_resplit(spark):
    chain = [(f"train/{i}", 0b11111 << (5 * i)) for i in range(3)] + [("val/x", 0b1 << 60), ("val/none", None)]
    chain += [("train/c1", 0xFF00), ("train/c2", 0xFF00)]
    images = spark.createDataFrame(chain, "key string, hash bigint")
    got = dict(duplicates.components(spark, images, 10).collect())
    assert got["val/none"] == "val/none" and got["train/c1"] == got["train/c2"]
    b = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(chain)], "key string, cls int")
    members = spark.createDataFrame(list(got.items()), "key string, group_key string")
    grouped = resplit.groups(members, b)
    proposal = resplit.propose(spark, grouped, 0.3)
    assert proposal.count() == len(set(got.values())) and {r["split"] for r in proposal.collect()} == {"train", "val"}


def test_leakage_compares_names_as_written(spark):
    images = spark.createDataFrame([("train/a", "train", 7), ("val/b", "val", 7), ("VAL/c", "VAL", 7), ("val/d", "val", 7 + (0b111111 << 20))], "key string, split string, hash bigint")
    assert [r["key"] for r in duplicates.leakage(images).collect()] == ["val/b"]


def test_imbalance_and_roles(spark):
    data = [("train", 0, 500), ("train", 1, 10), ("train", 2, 9), ("training", 3, 40), ("val", 0, 3), ("val", 1, 2), ("val", 2, 3)]
    df = spark.createDataFrame([(f"{s}/{i}", s, c) for s, c, n in data for i in range(n)], "key string, split string, cls int")
    got = {r["cls"]: r for r in classes.imbalance(df, 5).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["rare"] and got[1]["unmeasured"] and got[2]["few"] and got[3]["absent"]
    assert {r["cls"] for r in classes.absent_from_val(df).collect()} == {3}


@pytest.mark.parametrize(("train", "val", "hit"), [(19, 0, False), (20, 0, True), (19, 1, False), (39, 2, True), (10, 10, False), (9, 11, True)])
def test_split_ratio(spark, train, val, hit):
    df = spark.createDataFrame([("train", "x")] * train + [("test", "x")] * val, "split string, image_path string")
    assert classes.split_ratio(df).count() == hit


def test_templates(spark):
    df = spark.createDataFrame([(f"k{i}", 1, s) for s, n in (("a", 5), ("b", 4)) for i in range(n)] + [("k0", 2, "b")], "key string, line_no int, sig string")
    assert [r["sig"] for r in classes.templates(df, ["sig"]).collect()] == ["a"]
    many = spark.createDataFrame([(f"k{i}", s, f"s{s:02}") for s in range(11) for i in range(5 + (s > 0))], "key string, line_no int, sig string")
    assert classes.templates(many, ["sig"]).count() == 11 and classes.template_hits(many, ["sig"]).select("sig").distinct().count() == 10


def test_names(spark):
    for raw, want in (("Traffic_Light", "trafficlight"), (" cars ", "car"), ("bus", "bus"), ("glass", "glass"), ("gas", "gas"), ("traffic-lights", "trafficlight")):
        assert names.normalise_name(raw) == want
        assert spark.range(1).select(names.normalised(F.lit(raw))).first()[0] == want
    assert vocab.role("VALID") == "val" and vocab.role("holdout") == "other"


def test_snap(spark):
    for v, want in ((-0.4, 0.0), (-0.5, -0.5), (-0.6, -0.6), (640.4, 640.0), (640.5, 640.5), (640.6, 640.6)):
        assert spark.range(1).select(geometry.snap(F.lit(v), F.lit(640.0))).first()[0] == want


def test_findings_verdict_and_gate(spark):
    hits = spark.createDataFrame([("tiny_box", "a", 1), ("tiny_box", "a", 2), ("missing_license", "<dataset>", None)], "type string, key string, line_no int")
    found = findings.findings(spark, hits)
    assert [(r["type"], r["n_items"], r["n_hits"]) for r in found.collect()] == [("missing_license", 1, 1), ("tiny_box", 1, 2)]
    assert findings.verdict(found).first()[0] == "fix_before_training"
    assert not findings.should_fail(found, "critical") and findings.should_fail(found, "major") and not findings.should_fail(found, "never")
    only = found.where("category = 'governance'")
    assert findings.verdict(only).first()[0] == "usable_with_caveats" and not findings.should_fail(only, "minor")


def test_scores(spark):
    f = lambda *x: spark.createDataFrame([(t, k) for t, k in x], "type string, key string")
    r = findings.score(f(("a", "1"), ("a", "2")), f(("a", "1"), ("a", "3"), ("b", "9")), f(("b", "9"))).first()
    assert (r["hits"], r["misses"], r["false_positives"], r["recall"], r["precision"]) == (1, 1, 1, 0.5, 0.5)


def test_manifest(spark):
    m = lambda *x: spark.createDataFrame(list(x), "path string, size bigint, sha1 string")
    a, b = m(("x", 1, "1"), ("y", 1, "2")), m(("y", 1, "3"), ("z", 1, "4"))
    assert dict(manifest.difference(a, b).collect()) == {"x": "removed", "y": "modified", "z": "added"}
    assert manifest.digest(a) == manifest.digest(a.orderBy(F.desc("path"))) != manifest.digest(b)
    assert manifest.bucket_digests(a).count() >= 1


def base_boxes(spark):
    rnd = random.Random(2)
    return spark.createDataFrame([(f"{s}/{i}", s, n, n % 3, 0.3 + rnd.random() / 5, 0.4 + rnd.random() / 10, 0.2 + rnd.random() / 10, 0.2) for s in ("train", "val") for i in range(10) for n in range(1, 4)], BOX)


@pytest.mark.parametrize("how", [inject.out_of_bounds, inject.degenerate, inject.tiny, lambda b, k: inject.bad_class(b, k, 3), inject.repeat])
def test_injected_defects_are_found(spark, how):
    clean = base_boxes(spark)
    checks = rows.geometry_checks(3)
    found = lambda b: {(r["type"], r["key"]) for r in rows.row_hits(b, checks).unionByName(rows.repeats(b).select(F.lit("duplicate_annotation").alias("type"), "key", "line_no")).collect()}
    assert found(clean) == set()
    broken, facts = how(clean, ["train/1", "val/2"])
    assert facts <= found(broken)


def test_more_injections(spark):
    clean = base_boxes(spark)
    images = spark.createDataFrame([(f"{s}/{i}", 640, 480) for s in ("train", "val") for i in range(10)], "key string, width int, height int")
    broken, facts = inject.denormalise(clean, ["train/3"], 640, 480)
    assert {("denormalised_coords", r["key"]) for r in rows.denormalised(broken, images).collect()} == facts
    back = apply.normalise(broken, images)
    assert rows.denormalised(back, images).count() == 0
    broken, _ = inject.drop_class_from_val(clean, 1)
    assert [r["cls"] for r in classes.absent_from_val(broken).collect()] == [1]
    broken, facts = inject.template(clean, [f"train/{i}" for i in range(6)])
    signed = broken.withColumns({f"s_{c}": geometry.micro(F.col(c)) for c in ("xc", "yc", "w", "h")})
    assert {("template_annotation", r["key"]) for r in classes.template_hits(signed, ["cls", "s_xc", "s_yc", "s_w", "s_h"]).collect()} == facts


def test_fixes_compose_and_refuse(spark):
    df = boxes(spark, [(0.95, 0.5, 0.2, 0.2), (0.5, 0.5, 0.0, 0.2), (0.5, 0.5, 0.0005, 0.2), (2.0, 2.0, 0.1, 0.1), (0.5, 0.5, 0.003, 0.003)])
    steps = [{"action": a} for a in ("drop_degenerate_boxes", "drop_tiny_boxes", "clip_or_drop_boxes")]
    left = apply.apply_steps(df, steps).collect()
    assert [r["key"] for r in left] == ["train/0"] and abs(left[0]["w"] - 0.15) < 1e-12
    assert apply.apply_steps(df, [{**s, "requires_human_review": True} for s in steps]).count() == 5
    with pytest.raises(ValueError):
        apply.apply_steps(df, steps, task="segment")
