"""Registered queries, one module per family, each with its oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ("ingest", "visibility", "retrieval", "grading", "packing", "questions", "answers", "contracts", "logs", "streams", "walks", "checks")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        part = getattr(importlib.import_module(f"evidex.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("ORACLE")


def flagship(spark, sf_dir):
    from evidex.plans.retrieval import flagship as run

    return run(spark, sf_dir)
