"""All registered queries and the SQL they are checked with."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("event", "season", "stats", "insights", "pages", "evidence")


def _gather(kind: str, attribute: str) -> dict:
    merged: dict = {}
    for group in _GROUPS:
        merged.update(getattr(import_module(f"gridlake.plans.{kind}_{group}"), attribute))
    return merged


def queries() -> dict:
    return _gather("catalog", "QUERIES")


def checks() -> dict[str, str]:
    return _gather("checks", "SQL")
