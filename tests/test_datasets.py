"""Real files: reading, checking, converting, reporting."""

import json
import shutil
import struct

import numpy as np
import pytest

from vetframe import cli, sources
from vetframe.functions import imagebytes
from vetframe.plans import agent, registry
from vetframe.plans.sweep import sweep
from vetframe.sinks import datasets, reports
from vetframe.sources import images, labelrows, yolo

from .conftest import png


def load(spark, root, pixels=True):
    t = sources.read_dataset(spark, str(root))
    if pixels:
        t.images = images.probe(spark, t.samples, str(root))
    return t


def types(result):
    return {f.type: f for f in result.found}


def test_clean_data_is_silent(spark, clean_root):
    result = sweep(spark, load(spark, clean_root), "split,metadata,privacy,annotations")
    assert not result.failed and not result.found and result.verdict() == "usable_with_caveats"


def test_defects_are_found(spark, clean_root):
    labels, pics = clean_root / "labels/train", clean_root / "images"
    (labels / "t000.txt").write_text("0 0.97 0.5 0.2 0.2\n1 0.5 0.5 0.0 0.2\n\n1 0.5 0.5 0.0005 0.0005\n7 0.5 0.5 0.2 0.2\n1 0.5 0.5 0.2\n0 0.3 0.3 0.1 0.1\n0 0.3 0.3 0.1 0.1\n")
    (labels / "t001.txt").unlink()
    (labels / "t002.txt").write_bytes(b"")
    (labels / "lonely.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    (labels / "t003.txt").write_text("".join(f"0 {32 + i} 20 10 9.{i}\n" for i in range(3)))
    shutil.copy(pics / "train/t005.png", pics / "val/v000.png")
    shutil.copy(pics / "train/t006.png", pics / "train/t007.png")
    (pics / "train/t008.png").write_bytes((pics / "train/t008.png").read_bytes()[:3000])
    (clean_root / "LICENSE").unlink()
    (clean_root / "data.yaml").write_text("names: [person, car, cup]\nnc: 4\n")
    result = sweep(spark, load(spark, clean_root), "all")
    got = types(result)
    want = {
        "out_of_bounds": ["train/t000", "train/t003"], "degenerate_box": ["train/t000"], "tiny_box": ["train/t000"], "class_id_out_of_range": ["train/t000"], "malformed_label_row": ["train/t000"],
        "duplicate_annotation": ["train/t000"], "missing_label_file": ["train/t001"], "empty_label_file": ["train/t002"], "orphan_label_file": ["train/lonely"], "denormalised_coords": ["train/t003"],
        "train_val_leakage": ["val/v000"], "near_duplicate_image": ["train/t006", "train/t007"], "corrupt_image": ["train/t008"], "missing_license": [], "yaml_inconsistency": [],
    }
    assert {t: got[t].items for t in want} == want
    assert not result.failed and result.verdict() == "blocked" and result.fails("critical") and not result.fails("never")
    t = load(spark, clean_root, pixels=False)
    doc = reports.scan_json(t, result)
    assert json.loads(reports.dumps(doc))["summary"]["critical"] > 3
    s = reports.sarif(t, result)["runs"][0]
    assert {r["level"] for r in s["results"]} == {"error", "warning", "note"} and all(r["locations"] for r in s["results"])
    assert "governance:" in reports.text(result) and "<section>" in reports.html_report(result) and "# Audit" in reports.markdown(result)
    plan = reports.fix_plan(t, result)
    assert any(x["requires_human_review"] for x in plan["steps"]) and "auto" in reports.plan_summary(plan)
    fixed = cli.fixed_boxes(spark, t, plan)
    assert fixed.where("w <= 0").count() == 0


def test_label_rows(spark):
    text = "0 0.5 0.5 0.1 0.1\r\n\n 1.9 1_0 .5 5. 1e-1 \x850 0.5 0.5 0.1 1d\n0 1 2 3\nnan 0 0 0 0\ninf 0 0 0 0\n1__0 0 0 0 0\n2 nan inf 0.1 0.1"
    files = spark.createDataFrame([("train/a", text)], "key string, content string")
    good, bad = labelrows.parse(labelrows.lines(files))
    assert [(r["line_no"], r["cls"]) for r in good.orderBy("line_no").collect()] == [(1, 0), (3, 1), (9, 2)]
    assert [(r["line_no"], r["reason"]) for r in bad.orderBy("line_no").collect()] == [(4, "non-numeric field"), (5, "expected 5 fields, found 4"), (6, "non-numeric field"), (7, "non-numeric field"), (8, "non-numeric field")]


def test_segments_and_poses(spark):
    files = spark.createDataFrame([("t/a", "0 0.2 0.2 0.8 0.2 0.8 0.8 0.2 0.8\n0 0.1 0.1 0.2 0.2")], "key string, content string")
    good, bad = labelrows.parse(labelrows.lines(files), "segment")
    r = good.first()
    assert len(r["polygon"]) == 4 and abs(r["w"] - 0.6) < 1e-12 and bad.count() == 1
    files = spark.createDataFrame([("t/a", "0 0.5 0.5 0.2 0.2 0.5 0.5 2 0.9 0.5 1")], "key string, content string")
    r = labelrows.parse(labelrows.lines(files), "pose", 2, 3)[0].first()
    assert [p["v"] for p in r["keypoints"]] == [2.0, 1.0]
    files = spark.createDataFrame([("t/a", "0 0.5 0.5 0.2 0.2 0.5 0.5 0.9 0.5")], "key string, content string")
    assert [p["v"] for p in labelrows.parse(labelrows.lines(files), "pose", 2, 2)[0].first()["keypoints"]] == [2.0, 2.0]


@pytest.mark.parametrize(("text", "error", "names"), [("names: {1: b, 0: a}", None, ["a", "b"]), ("names: [a]\nnc: 2", "nc is 2, but there are 1 names", ["a"]), ("names: [a]\nnc: x", "nc is no number: 'x'", ["a"]), ("nc: 3", "nc is 3, but there are 0 names", []), ("a: [", "invalid", [])])
def test_descriptions(spark, tmp_path, text, error, names):
    (tmp_path / "data.yaml").write_text(text)
    m = yolo.read_meta(spark, str(tmp_path))
    assert m.names == names and (m.yaml_error or "").startswith(error or "") and bool(m.yaml_error) == bool(error)


def to_coco(root, out):
    sizes = (64, 48)
    for split in ("train", "val"):
        pics, notes, n = [], [], 0
        for i, f in enumerate(sorted((root / "labels" / split).glob("*.txt"))):
            pics.append({"id": i, "file_name": f"{f.stem}.png", "width": sizes[0], "height": sizes[1]})
            for line in f.read_text().splitlines():
                c, x, y, w, h = map(float, line.split())
                n += 1
                notes.append({"id": n, "image_id": i, "category_id": int(c) * 10 + 5, "bbox": [(x - w / 2) * 64, (y - h / 2) * 48, w * 64, h * 48]})
        notes.append({"id": n + 1, "image_id": 999, "category_id": 5, "bbox": [0, 0, 1, 1]})
        notes.append({"id": n + 2, "image_id": 0, "category_id": 5, "bbox": [0, 0, 1]})
        (out / split).mkdir(parents=True)
        cats = [{"id": 5, "name": "person"}, {"id": 15, "name": "car"}, {"id": 25, "name": "cup"}]
        (out / split / "_annotations.coco.json").write_text(json.dumps({"images": pics, "annotations": notes, "categories": cats}))


def to_voc(root, out):
    (out / "Annotations").mkdir(parents=True)
    (out / "ImageSets/Main").mkdir(parents=True)
    names = ["person", "car", "cup"]
    for split in ("train", "val"):
        stems = []
        for f in sorted((root / "labels" / split).glob("*.txt")):
            objs = ""
            for line in f.read_text().splitlines():
                c, x, y, w, h = map(float, line.split())
                b = {"xmin": (x - w / 2) * 64 + 1, "ymin": (y - h / 2) * 48 + 1, "xmax": (x + w / 2) * 64 + 1, "ymax": (y + h / 2) * 48 + 1}
                objs += f"<object><name>{names[int(c)]}</name><bndbox>{''.join(f'<{k}>{v}</{k}>' for k, v in b.items())}</bndbox></object>"
            (out / "Annotations" / f"{f.stem}.xml").write_text(f"<annotation><filename>{f.stem}.png</filename><size><width>64</width><height>48</height></size>{objs}<object><name></name></object></annotation>")
            stems.append(f.stem)
        (out / "ImageSets/Main" / f"{split}.txt").write_text("\n".join(stems))
    (out / "ImageSets/Main/person_train.txt").write_text("t000 1\n")


def summary(t):
    rows = t.boxes.join(t.taxonomy, "cls").collect()
    return sorted((r["key"], r["name"], *(round(r[c], 6) for c in ("xc", "yc", "w", "h"))) for r in rows)


def test_formats_agree(spark, clean_root, tmp_path):
    (clean_root / "labels/train/t000.txt").write_text("0 0.97 0.5 0.2 0.2\n1 0.5 0.5 0.3 0.2\n2 0.5 0.5 0.3 0.2\n")
    to_coco(clean_root, tmp_path / "coco")
    to_voc(clean_root, tmp_path / "voc")
    assert [sources.detect_format(spark, str(p)) for p in (clean_root, tmp_path / "coco", tmp_path / "voc")] == ["yolo", "coco", "voc"]
    a, b, c = (sources.read_dataset(spark, str(p)) for p in (clean_root, tmp_path / "coco", tmp_path / "voc"))
    assert summary(a) == summary(b) == summary(c)
    found = [sweep(spark, t, pixels=False) for t in (a, b, c)]
    assert [{f.type: f.items for f in x.found if f.type != "missing_label_file" and f.type != "orphan_label_file"} for x in found][0].keys() >= {"out_of_bounds"}
    assert all(types(x)["out_of_bounds"].items == ["train/t000"] for x in found)
    out = tmp_path / "again"
    assert datasets.write_yolo(b, str(out)) == 21
    assert summary(sources.read_dataset(spark, str(out))) == summary(a)
    with pytest.raises(ValueError):
        sources.read_dataset(spark, str(tmp_path / "nothing"))


def jpeg(exif: bytes | None = None, tail: bytes = b"\x12\x34\xff\xd9") -> bytes:
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    app1 = seg(0xE1, b"Exif\0\0" + exif) if exif else b""
    return b"\xff\xd8" + app1 + seg(0xC0, b"\x08" + struct.pack(">HH", 48, 64) + b"\x01\x01\x11\0") + seg(0xDA, b"\x01\x01\0\0\x3f\0") + tail


def tiff(orientation: int, gps: bool) -> bytes:
    entries = [(274, 3, 1, orientation)] + ([(34853, 4, 1, 8 + 2 + 24 + 4)] if gps else [])
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    sub = struct.pack("<H", 1) + struct.pack("<HHII", 2, 5, 3, 0) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8) + body + (sub if gps else b"")


def test_image_bytes():
    plain, turned = jpeg(), jpeg(tiff(6, True))
    assert imagebytes.size(plain) == (64, 48) and imagebytes.check(plain) is None
    assert imagebytes.check(plain[:-2]) is not None and imagebytes.check(b"") is not None and imagebytes.check(plain[:20]) is not None
    assert imagebytes.exif(turned) == (6, True) and imagebytes.exif(plain) == (None, False) and imagebytes.exif(jpeg(tiff(3, False))) == (3, False)
    assert imagebytes.strip_exif(turned) == plain and imagebytes.strip_exif(b"other") == b"other"
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (48, 64, 3), np.uint8)
    assert (imagebytes.decode_png(png(pixels)) == pixels).all()
    near = pixels.copy()
    near[0, 0] ^= 1
    a, b = imagebytes.dhash(png(pixels)), imagebytes.dhash(png(near))
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and imagebytes.dhash(b"no image") is None
    assert imagebytes.dhash(png(np.full((48, 64, 3), 9, np.uint8))) == 0


def test_registry_groups_and_plugins(spark):
    assert {d.name for d in registry.available()} == {"structure_scan", "image_integrity_scan", "geometry_scan", "normalisation_scan", "class_scan", "class_distribution", "duplicate_scan", "polygon_scan", "keypoint_scan"}
    assert len(registry.available("all", experimental=True)) == 16
    with pytest.raises(ValueError):
        registry.available("nonsense")

    class Broken:
        name = "broken"

        def load(self):
            raise RuntimeError("no")

    assert "broken skipped" in registry.load_plugins([Broken()])[0]


def test_a_failing_detector_does_not_stop_the_sweep(spark, clean_root):
    from pyspark.sql import functions as F

    @registry.register("late", "fails when it runs", group="own")
    def late(t):
        bad = F.udf(lambda k: 1 // 0, "string")
        return t.boxes.select(F.lit("tiny_box").alias("type"), bad("key").alias("key"), "line_no", F.lit(None).cast("string").alias("note"))

    try:
        (clean_root / "labels/train/t001.txt").write_text("0 0.97 0.5 0.2 0.2\n")
        result = sweep(spark, load(spark, clean_root, pixels=False), "own", pixels=False)
    finally:
        del registry.REGISTRY["late"]
    assert "late" in result.failed and "out_of_bounds" in types(result)


class Scripted:
    def __init__(self, *replies):
        self.replies = list(replies)

    def chat(self, messages, tools):
        return self.replies.pop(0) if self.replies else {"content": ""}


def call(tool, **args):
    return {"content": "", "tool_calls": [{"name": tool, "args": args}]}


def test_agent_cannot_suppress_exact_findings(spark, clean_root):
    (clean_root / "labels/train/t001.txt").write_text("0 0.97 0.5 0.2 0.2\n")
    t = load(spark, clean_root, pixels=False)
    client = Scripted(call("dataset_summary"), call("run_detector", name="geometry_scan"), call("nonsense"), call("submit_report", verdict="blocked", decisions=[{"id": "geometry_scan:out_of_bounds:0", "report": False, "reason": "fine"}]))
    done = agent.audit(spark, t, client)
    assert done.verdict == "blocked" and [d.report for d in done.decisions] == [True] and "refused" in done.decisions[0].reason
    silent = agent.audit(spark, t, Scripted())
    assert any(d.finding.type == "out_of_bounds" for d in silent.decisions)


def test_tolerant_json():
    assert agent.tolerant_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert agent.tolerant_json('{"decisions": [{"id": "x", "report": tr')["decisions"][0]["id"] == "x"
    assert agent.tolerant_json("none") is None


def test_command_line(spark, clean_root, tmp_path, capsys):
    root = str(clean_root)
    run = lambda *a: cli.main(list(a), spark)
    assert run("scan", root) == 0 and run("nonsense") == 2 and run("scan", str(tmp_path / "nothing")) == 2 and run("detectors") == 0
    assert run("audit", root, "--no-pixels") == 4
    assert run("card", root) == 0 and run("verify-card", root) == 0
    first = tmp_path / "first.json"
    assert run("scan", root, "--output", "json", "--out", str(first), "--no-pixels") == 0
    (clean_root / "labels/train/t001.txt").write_text("0 0.97 0.5 0.2 0.2\n1 0.5 0.5 0.0 0.1\n")
    assert run("scan", root, "--no-pixels") == 1 and run("scan", root, "--no-pixels", "--fail-on", "never") == 0
    capsys.readouterr()
    assert run("verify-card", root) == 3 and "modified" in capsys.readouterr().out
    assert run("recheck", root, "--before", str(first), "--no-pixels") == 1
    t = load(spark, clean_root, pixels=False)
    plan = tmp_path / "plan.json"
    plan.write_text(reports.dumps(reports.fix_plan(t, sweep(spark, t, pixels=False))))
    assert run("apply", root, "--plan", str(plan), "--out", str(tmp_path / "fixed"), "--yes") == 0
    assert run("scan", str(tmp_path / "fixed"), "--no-pixels", "--fail-on", "critical") == 0
    assert run("diff", root, root, "--no-pixels") == 0 and run("resplit", root) == 0
    assert run("convert", root, "--out", str(tmp_path / "tables"), "--parquet") == 0
    assert run("merge", root, str(tmp_path / "fixed"), "--out", str(tmp_path / "merged")) == 0
    (tmp_path / "fixed/data.yaml").write_text("names: [Persons, car, cup]\n")
    assert run("merge", root, str(tmp_path / "fixed")) == 1


def test_whole_lists_beyond_what_a_report_shows(spark, clean_root, tmp_path, capsys):
    """201 orphan labels: all go when the plan is applied, and a new one is seen though the report lists only the first 200."""
    from vetframe import cli

    run = lambda *a: cli.main(list(a), spark)
    for i in range(201):
        (clean_root / f"labels/train/o{i:03}.txt").write_text("0 0.5 0.5 0.3 0.2\n")
    before, plan, out = str(tmp_path / "scan.json"), str(tmp_path / "plan.json"), tmp_path / "mended"
    run("scan", str(clean_root), "--no-pixels", "--output", "json", "--out", before, "--fix-plan", plan)
    spec = json.loads((tmp_path / "plan.json").read_text())
    steps = [s for s in spec["steps"] if s["type"] == "orphan_label_file"]
    assert (len(steps[0]["targets"]), steps[0]["n_targets"]) == (200, 201)
    for s in spec["steps"]:
        s["requires_human_review"] = False
    (tmp_path / "plan.json").write_text(json.dumps(spec))
    assert run("apply", str(clean_root), "--plan", plan, "--out", str(out), "--yes") == 0
    assert not list((out / "labels/train").glob("o*")) and len(list((out / "labels/train").glob("t*.txt"))) == 14
    assert len(list((out / "images").rglob("*.png"))) == 20 and (out / "images/val/v000.png").read_bytes() == (clean_root / "images/val/v000.png").read_bytes()
    assert run("recheck", str(clean_root), "--before", before, "--no-pixels") == 0
    (clean_root / "labels/train/zz.txt").write_text("0 0.5 0.5 0.3 0.2\n")
    capsys.readouterr()
    assert run("recheck", str(clean_root), "--before", before, "--no-pixels") == 1
    assert json.loads(capsys.readouterr().out) == {"resolved": 0, "introduced": 1, "remaining": 201}
    import shutil

    shutil.rmtree(before + ".items")  # without it only numbers can be compared
    assert run("recheck", str(clean_root), "--before", before, "--no-pixels") == 1
    assert json.loads(capsys.readouterr().out)["counted_only"] == ["orphan_label_file"]
    shutil.rmtree(plan + ".items")
    assert run("apply", str(clean_root), "--plan", plan, "--out", str(tmp_path / "no"), "--yes") == 2


def test_pixels_of_every_format(spark, clean_root, tmp_path):
    """A val image that copies a train image, and one that is cut: found in YOLO, COCO and VOC alike."""
    import shutil
    from argparse import Namespace

    from vetframe import cli

    (clean_root / "images/val/v000.png").write_bytes((clean_root / "images/train/t003.png").read_bytes())
    whole = (clean_root / "images/train/t005.png").read_bytes()
    (clean_root / "images/train/t005.png").write_bytes(whole[: len(whole) // 2])
    to_coco(clean_root, tmp_path / "coco")
    to_voc(clean_root, tmp_path / "voc")
    for f in (clean_root / "images").rglob("*.png"):
        shutil.copy(f, tmp_path / "coco" / f.parent.name)
        (tmp_path / "voc/JPEGImages").mkdir(exist_ok=True)
        shutil.copy(f, tmp_path / "voc/JPEGImages")
    for root in (clean_root, tmp_path / "coco", tmp_path / "voc"):
        tables = cli._open(spark, Namespace(root=str(root)))
        result = sweep(spark, tables)
        found = types(result)
        assert found["train_val_leakage"].items == ["val/v000"] and found["train_val_leakage"].evidence[0]["note"] == "as train/t003, 0 bits apart"
        assert found["corrupt_image"].items == ["train/t005"] and set(result.skipped) == {"polygon_scan", "keypoint_scan"}
    bare = sweep(spark, sources.read_dataset(spark, str(tmp_path / "voc")), pixels=True)
    assert {"duplicate_scan", "image_integrity_scan"} <= set(bare.skipped) and not set(bare.skipped) & set(bare.ran)
