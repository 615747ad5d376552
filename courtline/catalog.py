"""All registered queries, in the order their modules are listed."""

from __future__ import annotations

import importlib

from courtline.plans import registry

MODULES = [
    "schedule", "betting", "normalize", "odds", "plays", "ratings", "context", "monitor", "tables",
    "streams", "sinks", "jobs", "rows",
]


def entries() -> dict[str, registry.Entry]:
    for module in MODULES:
        importlib.import_module(f"courtline.plans.{module}")
    return registry.ENTRIES
