"""Registered queries: one catalog per area."""

from importlib import import_module

AREAS = ("data", "filter", "join", "aggregate", "window", "scalar", "control", "graph", "pipeline", "source")


def all_catalogs() -> list:
    return [import_module(f"strandloom.plans.{a}_queries").CATALOG for a in AREAS]
