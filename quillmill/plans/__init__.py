"""The registered queries, a module for each family, and their SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["retrieval", "content", "chat", "analytics", "catalogue", "assessing", "reporting", "searching", "sequences", "indexes", "monitoring", "tabular"]


def _gathered(name: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        found |= getattr(import_module(f"quillmill.plans.{family}"), name)
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracles() -> dict:
    return _gathered("ORACLES")
