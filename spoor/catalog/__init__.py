"""Registered queries over the given tables."""

import importlib

MODULES = ("stacks", "polls", "rebuild", "spans", "series", "memory", "fleet", "scalars", "checks", "sinks", "ingest")


def load_all():
    for name in MODULES:
        importlib.import_module(f"spoor.catalog.{name}")
    from spoor.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
