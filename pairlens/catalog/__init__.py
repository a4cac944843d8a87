"""Registered queries over the given tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

import importlib

from pairlens.catalog.registry import ORACLES, QUERIES

for _part in (
    "rates", "inference", "normalizing", "reading", "dataset", "sampling", "stepping", "texts", "requesting",
    "reporting", "streams",
):
    importlib.import_module(f"pairlens.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
