"""Running the selected detectors over one dataset.

All hits come from one union, so tables are read and shuffled once.  A lazy plan
fails only when it runs: if the fused run fails, detectors run one by one and
the one that failed is recorded.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..model import Tables
from ..operators import findings
from ..operators.duplicates import shared_table
from . import detectors  # noqa: F401  registers the built-in ones
from .registry import Detector, available, resolve_groups

#: Items that a report shows of each type; ``SweepResult.items`` has them all.
ITEMS_CAP = 200


@dataclass
class Finding:
    """One defect type of a dataset: full counts, the first items and evidence."""

    type: str
    severity: str
    category: str
    detector: str
    n_items: int
    n_hits: int
    items: list[str] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    fix: dict = field(default_factory=dict)
    id: str = ""

    @property
    def title(self) -> str:
        return f"{self.n_hits} x {self.type.replace('_', ' ')} in {self.n_items} item{'s' * (self.n_items != 1)}"


@dataclass
class SweepResult:
    hits: DataFrame | None
    found: list[Finding]
    ran: list[str]
    failed: dict[str, str]
    groups: tuple[str, ...]
    seconds: float
    #: Detectors that had nothing to read, as the tables they need are missing.
    skipped: list[str] = field(default_factory=list)

    def items(self, type_: str | None = None) -> DataFrame | None:
        """(type, item) of every item, or of those of one type; a dataset-level finding is its own item."""
        if self.hits is None:
            return None
        some = self.hits if type_ is None else self.hits.where(F.col("type") == type_)
        return some.select("type", F.when(F.col("key") == detectors.DATASET, F.col("type")).otherwise(F.col("key")).alias("item")).distinct()

    def counts(self) -> dict[str, int]:
        """Trainability findings by severity."""
        out = dict.fromkeys(vocab.SEVERITIES, 0)
        for f in self.found:
            if f.category == "trainability":
                out[f.severity] += 1
        return out

    def worst(self) -> str | None:
        return next((s for s, n in self.counts().items() if n), None)

    def verdict(self) -> str:
        return {"critical": "blocked", "major": "fix_before_training"}.get(self.worst() or "", "usable_with_caveats")

    def fails(self, level: str) -> bool:
        worst = self.worst()
        return level != "never" and worst is not None and vocab.RANK[worst] <= vocab.RANK[level]


def _plan(d: Detector, tables: Tables) -> DataFrame | None:
    found = d.run(tables)
    return None if found is None else found.withColumn("detector", F.lit(d.name))


def _materialised(spark: SparkSession, chosen: list[Detector], tables: Tables) -> tuple[DataFrame | None, dict[str, str], list[str]]:
    plans, failed, skipped = {}, {}, []
    for d in chosen:
        try:
            if (p := _plan(d, tables)) is not None:
                plans[d.name] = p
            else:
                skipped.append(d.name)
        except Exception as e:  # a detector may fail in any way, and the others still count
            failed[d.name] = f"{type(e).__name__}: {e}"
    if not plans:
        return None, failed, skipped
    try:
        return shared_table(spark, reduce(DataFrame.unionByName, plans.values()), "hits"), failed, skipped
    except Exception:
        done = []
        for name, p in plans.items():
            try:
                done.append(shared_table(spark, p, "hits"))
            except Exception as e:
                failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
        return (reduce(DataFrame.unionByName, done) if done else None), failed, skipped


def collect(spark: SparkSession, hits: DataFrame, cap: int = 12) -> list[Finding]:
    """Findings with full counts; items and evidence up to their caps, chosen by tasks."""
    table = findings.findings(spark, hits).collect()  # 32 rows at most
    places = {r["type"]: [] for r in table}
    for r in findings.evidence(hits, max(cap, 15)).orderBy("type", "place").collect():
        places[r["type"]].append(r.asDict())
    items = {r["type"]: [] for r in table}
    distinct = hits.where(F.col("key") != detectors.DATASET).groupBy("type", "key").agg(F.min("line_no").alias("line_no"))
    for r in findings.evidence(distinct, ITEMS_CAP).orderBy("type", "place").collect():
        items[r["type"]].append(r["key"])
    out = []
    numbers: dict[str, int] = {}
    for r in table:
        first = places[r["type"]][0]
        detector = first["detector"]
        most = vocab.EVIDENCE_CAP.get(detector, cap)
        action = vocab.ACTION.get(r["type"])
        n = r["n_items"] if items[r["type"]] else 0
        f = Finding(r["type"], r["severity"], r["category"], detector, n, r["n_hits"], items[r["type"]], [{k: e[k] for k in ("key", "line_no", "note")} for e in places[r["type"]][:most]])
        f.fix = {"action": action, "requires_human_review": r["type"] in vocab.NEEDS_HUMAN} if action else {}
        f.id = f"{detector}:{r['type']}:{numbers.setdefault(detector, 0)}"
        numbers[detector] += 1
        out.append(f)
    return sorted(out, key=lambda f: (vocab.RANK[f.severity], -f.n_items, f.type))


def sweep(spark: SparkSession, tables: Tables, groups: Iterable[str] | str | None = None, experimental: bool = False, pixels: bool = True) -> SweepResult:
    began = time.time()
    chosen = [d for d in available(groups, experimental, pixels) if not d.informational]
    hits, failed, skipped = _materialised(spark, chosen, tables)
    found = collect(spark, hits) if hits is not None else []
    ran = [d.name for d in chosen if d.name not in failed and d.name not in skipped]
    return SweepResult(hits, found, ran, failed, resolve_groups(groups), time.time() - began, skipped)
