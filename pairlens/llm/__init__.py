"""Operators of a training-data pipeline, each applied by one registered query."""

from __future__ import annotations

from pairlens.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
