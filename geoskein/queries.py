"""Queries of the core and their SQL for the check."""

from __future__ import annotations

import importlib

#: Modules with a dict QUERIES of name -> callable and a dict SQL of name -> text.
MODULES: list[str] = ["places", "cleaning", "joins", "access", "networks", "modelling", "robustness", "diagnostics"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(importlib.import_module(f"geoskein.plans.{module}"), name))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
