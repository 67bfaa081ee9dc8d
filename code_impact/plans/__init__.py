"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ("files", "java", "calls", "index", "graph", "patch", "diff", "review", "text", "events", "imports", "manifests", "vectors")


def load_all() -> None:
    for area in AREAS:
        import_module(f"code_impact.plans.{area}")
