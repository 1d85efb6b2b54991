"""Command line: scan audit apply card verify-card recheck diff resplit merge convert detectors.

Exit codes: 0 fine, 1 the gate failed or something was introduced, 2 wrong use,
3 a card doesn't match, 4 no model was reachable and a plain scan was made.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Tables
from .operators import apply, classes, duplicates, findings, manifest, merge, resplit
from .plans import registry
from .plans.sweep import SweepResult, sweep
from .session import session
from .sinks import datasets, reports
from .sources import files, images, read_dataset


def _open(spark: SparkSession, args) -> Tables:
    tables = read_dataset(spark, args.root, getattr(args, "format", None)).with_training(getattr(args, "imgsz", None), getattr(args, "max_det", None))
    probed = tables.images is not None and "hash" in tables.images.columns
    if not probed and not getattr(args, "no_pixels", False) and tables.samples.where("image_path IS NOT NULL").limit(1).count():
        tables.images = duplicates.shared_table(spark, images.probe(spark, tables.samples, args.root, tables.images), "images")
    tables.boxes = duplicates.shared_table(spark, tables.boxes, "boxes")
    return tables


def _sweep(spark: SparkSession, tables: Tables, args) -> SweepResult:
    return sweep(spark, tables, getattr(args, "checks", None), getattr(args, "experimental", False), not getattr(args, "no_pixels", False))


def _emit(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text)
    else:
        print(text)


def cmd_scan(spark, args) -> int:
    tables = _open(spark, args)
    result = _sweep(spark, tables, args)
    render = {"json": lambda: reports.dumps(reports.scan_json(tables, result)), "sarif": lambda: reports.dumps(reports.sarif(tables, result)), "html": lambda: reports.html_report(result), "md": lambda: reports.markdown(result), "text": lambda: reports.text(result)}
    _emit(render[args.output](), args.out)
    if args.out:
        reports.write_items(result, args.out)
    if args.fix_plan:
        Path(args.fix_plan).write_text(reports.dumps(reports.fix_plan(tables, result)))
        reports.write_items(result, args.fix_plan)
    return int(result.fails(args.fail_on))


def cmd_audit(spark, args) -> int:
    """Without a client the deterministic scan stands in."""
    client = getattr(args, "client", None)
    if client is None:
        cmd_scan(spark, args)
        return 4
    from .plans.agent import audit

    tables = _open(spark, args)
    done = audit(spark, tables, client, args.checks, args.experimental)
    shown = SweepResult(None, [d.finding for d in done.decisions if d.report], [], {}, (), 0.0)
    _emit(reports.markdown(shown, [(d.finding, d.reason) for d in done.decisions if not d.report]), args.out)
    return int(shown.fails(args.fail_on))


def fixed_boxes(spark: SparkSession, tables: Tables, plan: dict) -> DataFrame:
    return apply.apply_steps(tables.boxes, plan["steps"], tables.images, tables.meta.task)


def _targets(spark: SparkSession, plan_path: str, steps: list[dict]) -> DataFrame | None:
    """(key) of all targets of some steps: those in the plan, and where it lists only the first, those in the table beside it."""
    if not steps:
        return None
    cut = [s for s in steps if s.get("n_targets", len(s["targets"])) > len(s["targets"])]
    keys = spark.createDataFrame([(k,) for s in steps for k in s["targets"]], "key string")
    if not cut:
        return keys.distinct()
    if not Path(reports.items_path(plan_path)).exists():
        raise ValueError(f"{plan_path} lists only the first targets of {', '.join(s['type'] for s in cut)}, and {reports.items_path(plan_path)} is missing")
    whole = spark.read.parquet(reports.items_path(plan_path)).where(F.col("type").isin([s["type"] for s in cut]))
    return keys.union(whole.select(F.col("item").alias("key"))).distinct()


def cmd_apply(spark, args) -> int:
    """Write a mended copy; the source is never touched."""
    plan = json.loads(Path(args.plan).read_text())
    steps = apply.automatable(plan["steps"])
    print(reports.plan_summary(plan))
    if not steps:
        return 0
    if not args.yes and input("type apply to go on: ").strip() != "apply":
        print("nothing was changed")
        return 0
    tables = _open(spark, args)
    gone = _targets(spark, args.plan, [x for x in steps if x["action"] in ("remove_corrupt_images", "delete_orphan_labels")])
    samples = tables.samples if gone is None else tables.samples.join(gone, "key", "left_anti")
    boxes = fixed_boxes(spark, tables, plan).join(samples.select("key"), "key", "left_semi")
    stripped = _targets(spark, args.plan, [x for x in steps if x["action"] == "strip_exif_metadata"])
    n = datasets.write_yolo(Tables(tables.meta, samples, boxes), args.out, images=True, stripped=stripped)
    print(f"{n} files in {args.out}")
    return 0


def _fingerprint(spark: SparkSession, root: str) -> tuple[DataFrame, str, dict]:
    m = duplicates.shared_table(spark, files.manifest(spark, root), "manifest")
    t = manifest.totals(m).first()
    return m, manifest.digest(m), {"files": t["files"], "bytes": t["bytes"]}


def cmd_card(spark, args) -> int:
    tables = _open(spark, args)
    result = _sweep(spark, tables, args)
    m, digest, totals = _fingerprint(spark, args.root)
    counts = [(r["name"], r["n"]) for r in classes.distribution(tables.boxes, tables.taxonomy).groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").collect()]
    card = reports.card(tables, result, digest, totals, counts)
    out = Path(args.out or args.root)
    out.mkdir(parents=True, exist_ok=True)
    (out / "health.json").write_text(reports.dumps(card))
    if args.out:  # a folder of items within the dataset would change its fingerprint
        reports.write_items(result, str(out / "health.json"))
    (out / "DATASET_HEALTH.md").write_text(reports.card_markdown(card))
    with (out / "manifest.tsv").open("w") as f:
        for r in m.orderBy("path").toLocalIterator():
            f.write(f"{r['path']}\t{r['size']}\t{r['sha1']}\n")
    return 0


def cmd_verify_card(spark, args) -> int:
    base = Path(args.card or args.root)
    card = json.loads((base / "health.json").read_text())
    m, digest, _ = _fingerprint(spark, args.root)
    if digest == card["fingerprint"]["sha256"]:
        print("the card matches")
        return 0
    if (base / "manifest.tsv").exists():
        for r in manifest.difference(files.read_manifest(spark, str(base / "manifest.tsv")), m).orderBy("path").limit(50).collect():
            print(f"{r['status']:9} {r['path']}")
    return 3


def cmd_recheck(spark, args) -> int:
    """Compare with an earlier scan or card; the table beside it holds whole item lists.

    Without that table a type whose list was cut can't be compared item by item:
    what it has more of than before counts as introduced.
    """
    before = json.loads(Path(args.before).read_text())
    listed = [*before["findings"], *before.get("governance_findings", [])]
    facts = spark.createDataFrame([(f["type"], k) for f in listed for k in (f["items"] or [f["type"]])], "type string, item string")
    capped = {f["type"]: f["n_items"] for f in listed if f["n_items"] > len(f["items"]) > 0}
    if capped and Path(reports.items_path(args.before)).exists():
        facts, capped = spark.read.parquet(reports.items_path(args.before)), {}
    result = _sweep(spark, _open(spark, args), args)
    now = result.items() if result.hits is not None else spark.createDataFrame([], "type string, item string")
    status = findings.recheck(facts, now)
    n = {(r["type"], r["status"]): r["n"] for r in status.groupBy("type", "status").agg(F.count("*").alias("n")).collect()}
    for type_, was in capped.items():
        is_ = n.get((type_, "introduced"), 0) + n.get((type_, "remaining"), 0)
        n[type_, "introduced"], n[type_, "resolved"], n[type_, "remaining"] = max(is_ - was, 0), max(was - is_, 0), min(is_, was)
    total = {k: sum(v for (_, status_), v in n.items() if status_ == k) for k in ("resolved", "introduced", "remaining")}
    print(json.dumps(total | ({"counted_only": sorted(capped)} if capped else {})))
    return int(total["introduced"] > 0)


def _measures(spark, tables: Tables, result: SweepResult) -> DataFrame:
    s = classes.summary(tables.samples).agg(F.sum("images"), F.sum("boxes")).first()
    rows = [("images", s[0] or 0), ("boxes", s[1] or 0), ("classes", tables.meta.nc), *result.counts().items(), ("governance", sum(f.category == "governance" for f in result.found))]
    return spark.createDataFrame([(k, int(v)) for k, v in rows], "measure string, n bigint")


def cmd_diff(spark, args) -> int:
    done = []
    for root in (args.root, args.other):
        tables = _open(spark, argparse.Namespace(**{**vars(args), "root": root}))
        result = _sweep(spark, tables, args)
        done.append((_measures(spark, tables, result), {f.type for f in result.found}))
    for r in findings.difference(done[0][0], done[1][0]).collect():
        print(f"{r['measure']:12} {r['a']:10} {r['b']:10} {r['delta']:+}")
    print("only in the first:", *sorted(done[0][1] - done[1][1]))
    print("only in the second:", *sorted(done[1][1] - done[0][1]))
    return 0


def cmd_resplit(spark, args) -> int:
    tables = _open(spark, args)
    hashed = tables.images.select("key", "hash") if tables.images is not None and "hash" in tables.images.columns else tables.samples.select("key", F.lit(None).cast("long").alias("hash"))
    members = duplicates.shared_table(spark, duplicates.components(spark, hashed), "members")
    proposal = duplicates.shared_table(spark, resplit.propose(spark, resplit.groups(members, tables.boxes), args.fraction), "proposal")
    placed = members.join(proposal, "group_key").select("key", "split")
    counts = {r["split"]: r["n"] for r in placed.groupBy("split").agg(F.count("*").alias("n")).collect()}
    again = hashed.join(placed, "key").select("key", "split", "hash")
    leaks = duplicates.leakage(again).limit(1).count()
    print(json.dumps({"schema": "vetframe/split-proposal/1", "counts": counts, "missing_in_val": [r["cls"] for r in resplit.missing_classes(members, tables.boxes, proposal).collect()], "leaks": leaks}))
    if args.out:
        placed.write.mode("overwrite").parquet(args.out)
    if args.dataset:
        fresh = duplicates.shared_table(spark, placed.select("key", F.col("split").alias("to")), "placed")
        moved = lambda df: df.join(fresh, "key").withColumn("key", F.concat_ws("/", "to", F.regexp_replace("key", "/", "_"))).withColumn("split", F.col("to")).drop("to")
        datasets.write_yolo(Tables(tables.meta, moved(tables.samples), moved(tables.boxes)), args.dataset, images=True)
    return int(leaks > 0)


def cmd_merge(spark, args) -> int:
    tables = [read_dataset(spark, r) for r in args.roots]
    taxonomies = spark.createDataFrame([(i, c, n) for i, t in enumerate(tables) for c, n in enumerate(t.meta.names)], "source int, cls int, name string")
    variants = [r["norm"] for r in merge.name_variants(taxonomies).collect()]
    print(json.dumps({"schema": "vetframe/merge-plan/1", "needs_a_decision": bool(variants), "name_variants": variants, "id_collisions": [r["cls"] for r in merge.id_collisions(taxonomies).collect()]}))
    if variants and not args.force:
        return 1
    if args.out:
        samples, boxes = (None, None)
        for i, t in enumerate(tables):
            s, b = t.samples.withColumn("source", F.lit(i)), t.boxes.withColumn("source", F.lit(i))
            samples, boxes = (s, b) if samples is None else (samples.unionByName(s), boxes.unionByName(b))
        lost = sum(t.parse_errors.limit(1).count() for t in tables)
        if lost and not args.force:
            print("some label rows can't be parsed and would be lost; --force merges without them")
            return 1
        merged = merge.merge_boxes(boxes, taxonomies, merge.filename_collisions(samples))
        merged.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/boxes")
        merge.merged_taxonomy(taxonomies).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/taxonomy")
    return 0


def cmd_convert(spark, args) -> int:
    tables = read_dataset(spark, args.root, args.format)
    if args.parquet:
        datasets.write_parquet(tables, args.out)
    else:
        print(f"{datasets.write_yolo(tables, args.out, images=True)} files in {args.out}")
    return 0


def cmd_detectors(spark, args) -> int:
    for d in registry.available("all", experimental=True):
        print(f"{d.name:26} {d.group:12} {'experimental ' if d.experimental else ''}{d.description}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vetframe", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, root: bool = True) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        if root:
            s.add_argument("root")
            s.add_argument("--format", choices=("yolo", "coco", "voc"))
        return s

    for name, run in (("scan", cmd_scan), ("audit", cmd_audit), ("card", cmd_card), ("recheck", cmd_recheck), ("diff", cmd_diff)):
        s = add(name, run)
        s.add_argument("--checks", default="", help="groups beside core, or all")
        s.add_argument("--imgsz", type=int)
        s.add_argument("--max-det", type=int)
        s.add_argument("--no-pixels", action="store_true")
        s.add_argument("--experimental", action="store_true")
        s.add_argument("--out")
        if name in ("scan", "audit"):
            s.add_argument("--output", choices=("text", "json", "sarif", "html", "md"), default="text")
            s.add_argument("--fail-on", choices=("critical", "major", "minor", "never"), default="critical")
            s.add_argument("--fix-plan", help="write a plan for apply as well")
        if name == "recheck":
            s.add_argument("--before", required=True)
        if name == "diff":
            s.add_argument("other")
    s = add("apply", cmd_apply)
    s.add_argument("--plan", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--yes", action="store_true")
    s = add("verify-card", cmd_verify_card)
    s.add_argument("--card")
    s = add("resplit", cmd_resplit)
    s.add_argument("--fraction", type=float, default=0.2)
    s.add_argument("--out")
    s.add_argument("--dataset", help="write the data in its new splits as well")
    s = add("merge", cmd_merge, root=False)
    s.add_argument("roots", nargs="+")
    s.add_argument("--out")
    s.add_argument("--force", action="store_true")
    s = add("convert", cmd_convert)
    s.add_argument("--out", required=True)
    s.add_argument("--parquet", action="store_true")
    add("detectors", cmd_detectors, root=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    for said in registry.load_plugins():
        print(said, file=sys.stderr)
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return args.run(spark or session(), args)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
