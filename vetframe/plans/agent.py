"""Triage by a language model, behind gates in code.

The client is any object with ``chat(messages, tools) -> {"content", "tool_calls"}``.
The model may order findings and give reasons.  It cannot make a finding, and it
cannot suppress one that an exact check made.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import functions as F

from .. import vocab
from ..model import Tables
from ..operators import classes
from .registry import REGISTRY, available
from .sweep import Finding, SweepResult, collect, sweep

MOST_STEPS, STUCK = 24, 3


class Client(Protocol):
    def chat(self, messages: list[dict], tools: list[str]) -> dict: ...


@dataclass
class Decision:
    finding: Finding
    report: bool = True
    reason: str = ""
    verified: bool | None = None


@dataclass
class Audit:
    verdict: str
    headline: str
    decisions: list[Decision]
    trajectory: list[dict] = field(default_factory=list)


class ToolBox:
    """What the model may ask for; every answer is small."""

    names = ("dataset_summary", "list_detectors", "run_detector", "inspect_finding", "read_label_file", "class_distribution", "submit_report")

    def __init__(self, spark, tables: Tables, groups=None, experimental: bool = False) -> None:
        self.spark, self.tables, self.groups, self.experimental = spark, tables, groups, experimental
        self.found: dict[str, Finding] = {}
        self.ran: set[str] = set()

    def call(self, name: str, args: dict) -> dict:
        if name not in self.names or name == "submit_report":
            return {"error": f"unknown tool {name}"}
        try:
            return getattr(self, name)(**args)
        except (TypeError, KeyError, ValueError) as e:
            return {"error": f"{type(e).__name__}: {e}"}

    def dataset_summary(self) -> dict:
        return {"splits": [r.asDict() for r in classes.summary(self.tables.samples).collect()], "classes": self.tables.meta.names, "task": self.tables.meta.task}

    def list_detectors(self) -> dict:
        return {"detectors": [{"name": d.name, "description": d.description, "covers": list(d.covers)} for d in available(self.groups, self.experimental)]}

    def run_detector(self, name: str) -> dict:
        if name not in {d.name for d in available(self.groups, self.experimental)}:
            raise KeyError(name)
        hits = REGISTRY[name].run(self.tables)
        self.ran.add(name)
        some = collect(self.spark, hits.withColumn("detector", F.lit(name))) if hits is not None and not REGISTRY[name].informational else []
        self.found |= {f.id: f for f in some}
        return {"findings": [{"id": f.id, "type": f.type, "severity": f.severity, "title": f.title} for f in some]}

    def inspect_finding(self, id: str) -> dict:
        f = self.found[id]
        return {"items": f.items[:60], "evidence": f.evidence, "fix": f.fix}

    def read_label_file(self, key: str) -> dict:
        rows = self.tables.boxes.where(F.col("key") == key).orderBy("line_no").limit(60)
        return {"rows": [r.asDict() for r in rows.select("line_no", "cls", "xc", "yc", "w", "h").collect()]}

    def class_distribution(self) -> dict:
        return {"counts": [r.asDict() for r in classes.distribution(self.tables.boxes, self.tables.taxonomy).collect()]}


def tolerant_json(text: str) -> dict | None:
    """The first JSON object in a reply, fenced or bare; one cut off is closed where it broke."""
    text = re.sub(r"^```(?:json)?|```$", "", text.strip(), flags=re.M)
    start = text.find("{")
    if start < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text[start:])[0]
    except ValueError:
        pass
    body = text[start:]
    while body:
        stack, inside, escaped = [], False, False
        for c in body:
            if inside:
                inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        try:
            return json.loads(body.rstrip().rstrip(",") + '"' * inside + "".join(reversed(stack)))
        except ValueError:
            body = body[: max(body.rfind(","), body.rfind("{"), 0)]
    return None


def resolve(found: dict[str, Finding], report: dict) -> list[Decision]:
    """Decisions on every finding: unmentioned ones are reported, unknown ids are ignored, exact ones can't be suppressed."""
    said = {d.get("id"): d for d in report.get("decisions", []) if isinstance(d, dict)}
    out = []
    for id_, f in found.items():
        d = said.get(id_, {})
        drop = d.get("report") is False and REGISTRY[f.detector].experimental
        why = str(d.get("reason", ""))
        if d.get("report") is False and not drop:
            why = f"suppression refused: {f.detector} is exact. {why}".strip()
        out.append(Decision(f, not drop, why))
    order = {id_: i for i, id_ in enumerate(said)}
    return sorted(out, key=lambda d: (not d.report, vocab.RANK[d.finding.severity], order.get(d.finding.id, len(order))))


def verify(client: Client, decisions: list[Decision], log: list[dict]) -> None:
    """Argue each suppression again; a reply that can't be read keeps the decision."""
    for d in decisions:
        if d.report:
            continue
        reply = client.chat([{"role": "user", "content": f"Argue that this finding is real, then decide. Answer JSON with the key suppress. {d.finding.title}: {d.reason}"}], [])
        parsed = tolerant_json(reply.get("content") or "")
        log.append({"kind": "verify", "id": d.finding.id, "reply": parsed})
        if parsed is not None and isinstance(parsed.get("suppress"), bool):
            d.verified = parsed["suppress"]
            d.report = not parsed["suppress"]


def audit(spark, tables: Tables, client: Client, groups=None, experimental: bool = False) -> Audit:
    """Let the model run detectors and report; what it leaves out is run and reported anyway."""
    box, log, report, stuck = ToolBox(spark, tables, groups, experimental), [], None, 0
    messages = [{"role": "user", "content": "Audit the dataset with the tools, then call submit_report."}]
    for _ in range(MOST_STEPS):
        reply = client.chat(messages, list(ToolBox.names))
        calls = reply.get("tool_calls") or []
        log.append({"kind": "llm", "calls": [c.get("name") for c in calls]})
        if not calls:
            stuck += 1
            report = tolerant_json(reply.get("content") or "")
            if report is not None or stuck >= STUCK:
                break
            messages.append({"role": "user", "content": "Call a tool."})
            continue
        stuck = 0
        for c in calls:
            if c["name"] == "submit_report":
                report = c.get("args") or {}
                break
            answer = box.call(c["name"], c.get("args") or {})
            log.append({"kind": "tool", "name": c["name"]})
            messages.append({"role": "tool", "name": c["name"], "content": json.dumps(answer, default=str)})
        if report is not None:
            break
    if not box.ran or report is None:
        swept: SweepResult = sweep(spark, tables, groups, experimental)
        box.found |= {f.id: f for f in swept.found}
        log.append({"kind": "note", "text": "default sweep"})
    decisions = resolve(box.found, report or {})
    verify(client, decisions, log)
    rule = SweepResult(None, [d.finding for d in decisions if d.report], [], {}, (), 0.0).verdict()
    return Audit((report or {}).get("verdict") or rule, str((report or {}).get("headline", "")), decisions, log)
