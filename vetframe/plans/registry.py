"""Named detectors, their groups, and plug-ins.

A detector turns the canonical tables into a lazy frame of hits.  Unselected
detectors build no plan at all.
"""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..model import Tables

GROUPS = ("core", "split", "metadata", "privacy", "training", "annotations")
PLUGINS = "vetframe.detectors"
Detect = Callable[[Tables], DataFrame | None]


@dataclass(frozen=True)
class Detector:
    name: str
    description: str
    run: Detect
    covers: tuple[str, ...] = ()
    group: str = "core"
    reads_pixels: bool = False
    heavy: bool = False
    experimental: bool = False
    informational: bool = False
    origin: str = "builtin"


REGISTRY: dict[str, Detector] = {}


def register(name: str, description: str, **options) -> Callable[[Detect], Detect]:
    """Add the decorated function as a detector; a name registered again is replaced."""

    def add(run: Detect) -> Detect:
        REGISTRY[name] = Detector(name, description, run, **options)
        return run

    return add


def resolve_groups(asked: Iterable[str] | str | None) -> tuple[str, ...]:
    """``core`` and what is asked for; ``all`` is every group; an unknown name raises."""
    names = [x.strip() for x in asked.split(",")] if isinstance(asked, str) else list(asked or ())
    names = [x for x in names if x]
    known = {*GROUPS, *(d.group for d in REGISTRY.values())}
    if unknown := sorted(set(names) - known - {"all"}):
        raise ValueError(f"unknown group: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    return tuple(g for g in sorted(known) if g == "core" or "all" in names or g in names)


def available(groups: Iterable[str] | str | None = None, experimental: bool = False, pixels: bool = True) -> list[Detector]:
    chosen = resolve_groups(groups)
    return [d for d in REGISTRY.values() if d.group in chosen and (experimental or not d.experimental) and (pixels or not d.reads_pixels)]


def load_plugins(entry_points: Iterable | None = None) -> list[str]:
    """Load detectors that other packages offer; one that fails is reported and skipped.  Returns the messages."""
    said = []
    for point in importlib.metadata.entry_points(group=PLUGINS) if entry_points is None else entry_points:
        before = set(REGISTRY)
        try:
            found = point.load()
            if callable(found) and not set(REGISTRY) - before:
                found()
        except Exception as e:  # a plug-in may fail in any way
            said.append(f"plug-in {point.name} skipped: {type(e).__name__}: {e}")
            continue
        for name in set(REGISTRY) - before:
            d = REGISTRY[name]
            REGISTRY[name] = Detector(**{**d.__dict__, "origin": point.name})
    return said
