"""Reports of a sweep: JSON, SARIF, Markdown, HTML, text.  They hold findings only, never rows."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

from .. import vocab
from ..model import Tables
from ..plans.sweep import Finding, SweepResult

LEVELS = {"critical": "error", "major": "warning", "minor": "note"}
SARIF_LOCATIONS, CARD_ITEMS = 100, 200


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def finding_dict(f: Finding, items: int = CARD_ITEMS) -> dict:
    return {
        "id": f.id, "type": f.type, "title": f.title, "severity": f.severity, "category": f.category, "detector": f.detector,
        "n_items": f.n_items, "n_hits": f.n_hits, "items": f.items[:items], "evidence": f.evidence, "fix": f.fix,
    }


def scan_json(tables: Tables, result: SweepResult) -> dict:
    return {
        "schema": "vetframe/scan/1", "generated": _now(), "dataset": {"root": tables.meta.root, "task": tables.meta.task, "classes": tables.meta.names},
        "checks": {"ran": result.ran, "failed": result.failed, "skipped": result.skipped, "groups": list(result.groups), "seconds": round(result.seconds, 3)},
        "verdict": result.verdict(), "summary": result.counts(), "findings": [finding_dict(f) for f in result.found],
    }


def sarif(tables: Tables, result: SweepResult, paths: dict[str, str] | None = None) -> dict:
    """SARIF 2.1.0; a dataset-level finding lies on the root."""
    name = tables.meta.root.rstrip("/").rsplit("/", 1)[-1]
    uri = lambda key: f"{name}/{(paths or {}).get(key, f'labels/{key}.txt')}" if key else f"{name}/"

    def location(key: str | None, line: int | None) -> dict:
        at = {"artifactLocation": {"uri": uri(key)}}
        return {"physicalLocation": at | ({"region": {"startLine": line}} if line else {})}

    results = []
    for f in result.found:
        lines = {e["key"]: e["line_no"] for e in reversed(f.evidence)}
        where = [location(k, lines.get(k)) for k in f.items[:SARIF_LOCATIONS]] or [location(None, None)]
        results.append({"ruleId": f.type, "level": LEVELS[f.severity], "message": {"text": f.title}, "locations": where})
    rules = [{"id": t, "defaultConfiguration": {"level": LEVELS[vocab.SEVERITY[t]]}} for t in sorted({f.type for f in result.found})]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "vetframe", "rules": rules}}, "results": results}]}


def text(result: SweepResult) -> str:
    """Trainability first, governance apart."""
    out = []
    for category in ("trainability", "governance"):
        some = [f for f in result.found if f.category == category]
        if category == "governance" and some:
            out.append("governance:")
        out += [f"{f.severity:8} {f.title}" for f in some]
    out += [f"failed   {name}: {why}" for name, why in result.failed.items()]
    return "\n".join([*out, f"verdict: {result.verdict()}"])


def markdown(result: SweepResult, suppressed: list[tuple[Finding, str]] = ()) -> str:
    out = [f"# Audit\n\n**{result.verdict()}**"]
    for f in result.found:
        if any(f is s for s, _ in suppressed):
            continue
        out.append(f"\n## {f.title} ({f.severity})\n")
        out += [f"- `{k}`" for k in f.items[:8]]
        out += [f"  - {e['key']}" + (f":{e['line_no']}" if e["line_no"] else "") + (f" {e['note']}" if e["note"] else "") for e in f.evidence[:5]]
        if f.fix:
            out.append(f"\nFix: `{f.fix['action']}`" + (" after review" if f.fix["requires_human_review"] else ""))
    if suppressed:
        out.append("\n## Suppressed\n")
        out += [f"- {f.title}: {why}" for f, why in suppressed]
    return "\n".join(out) + "\n"


def fix_plan(tables: Tables, result: SweepResult, suppressed: set[str] = frozenset()) -> dict:
    """Steps with the first targets of each; where there are more, ``write_items`` beside the plan lists them all."""
    steps = [
        {"finding_id": f.id, "type": f.type, "severity": f.severity, "action": f.fix.get("action", "review"), "targets": f.items, "n_targets": f.n_items, "detail": f.title, "requires_human_review": f.type in vocab.NEEDS_HUMAN or not f.fix}
        for f in result.found if f.id not in suppressed
    ]
    return {"schema": "vetframe/fix-plan/1", "dataset": tables.meta.root, "verdict": result.verdict(), "generated": _now(), "approved": False, "steps": steps}


def items_path(report: str) -> str:
    """Where the whole item list of a report lies: a Parquet table beside it."""
    return f"{report}.items"


def write_items(result: SweepResult, report: str) -> None:
    """Every (type, item) of a sweep, beside the report that shows the first of them."""
    if (items := result.items()) is not None:
        items.write.mode("overwrite").parquet(items_path(report))


def plan_summary(plan: dict) -> str:
    return "\n".join(f"{'manual' if s['requires_human_review'] or s['action'] not in vocab.AUTOMATABLE else 'auto  '} {s['action']}: {s['detail']}" for s in plan["steps"])


def card(tables: Tables, result: SweepResult, digest: str, totals: dict, classes: list[tuple[str, int]]) -> dict:
    """Health card; governance findings stand apart and never decide the verdict."""
    parts = {c: [finding_dict(f) for f in result.found if f.category == c] for c in ("trainability", "governance")}
    return {
        "schema": "vetframe/health/1", "generated": _now(), "dataset": {"root": tables.meta.root, "task": tables.meta.task, "class_boxes": dict(classes)},
        "fingerprint": {"sha256": digest, **totals}, "checks": {"ran": result.ran, "failed": result.failed, "skipped": result.skipped, "groups": list(result.groups)},
        "verdict": result.verdict(), "summary": result.counts(), "findings": parts["trainability"], "governance_findings": parts["governance"],
    }


def card_markdown(c: dict) -> str:
    head = [f"# Dataset health: {c['verdict']}", "", f"Fingerprint `{c['fingerprint']['sha256']}` over {c['fingerprint']['files']} files, {c['fingerprint']['bytes']} bytes.", "", "| class | boxes |", "|-|-|"]
    head += [f"| {n} | {k} |" for n, k in list(c["dataset"]["class_boxes"].items())[:40]]
    for title, part in (("Findings", c["findings"]), ("Governance", c["governance_findings"])):
        head += ["", f"## {title}", ""] + [f"- **{f['severity']}** {f['title']}" for f in part]
    return "\n".join(head) + "\n"


def html_report(result: SweepResult, pictures: dict[str, str] | None = None, boxes: dict[str, list[dict]] | None = None, each: int = 8) -> str:
    """One page without outside files.  ``pictures`` are data URIs by key; boxes on lines that a finding names are red, others grey."""
    body = []
    for f in result.found:
        named = {(e["key"], e["line_no"]) for e in f.evidence if e["line_no"]}
        shown = []
        for k in [k for k in f.items if k in (pictures or {})][:each]:
            marks = "".join(
                f'<rect x="{100 * (b["xc"] - b["w"] / 2):.3f}" y="{100 * (b["yc"] - b["h"] / 2):.3f}" width="{100 * b["w"]:.3f}" height="{100 * b["h"]:.3f}" class="{"bad" if (k, b["line_no"]) in named else "near"}"/>'
                for b in (boxes or {}).get(k, [])
            )
            shown.append(f'<figure><div><img src="{html.escape(pictures[k])}" alt=""><svg viewBox="0 0 100 100" preserveAspectRatio="none">{marks}</svg></div><figcaption>{html.escape(k)}</figcaption></figure>')
        rest = "".join(f"<li>{html.escape(k)}</li>" for k in f.items[:each])
        body.append(f"<section><h2>{html.escape(f.title)} <small>{f.severity}</small></h2>{''.join(shown)}<ul>{rest}</ul></section>")
    style = "body{font:15px sans-serif;margin:2em}figure{display:inline-block;margin:4px}figure div{position:relative}img{width:320px;display:block}svg{position:absolute;inset:0;width:100%;height:100%}rect{fill:none;stroke-width:.6}.bad{stroke:#c00}.near{stroke:#888}"
    return f"<!doctype html><meta charset=utf-8><title>Audit</title><style>{style}</style><h1>{result.verdict()}</h1>{''.join(body)}"


def dumps(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)
