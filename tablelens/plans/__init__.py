"""Registered queries over the standard tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib

from tablelens.plans.registry import ORACLE, QUERIES

FAMILIES = (
    "relational", "profile", "correlation", "anomaly", "association", "forecast", "words", "pages", "retrieval", "charts", "usage", "ingest",
)


def load_all():
    """Import every family once; returns the query and SQL registries."""
    for family in FAMILIES:
        importlib.import_module(f"tablelens.plans.{family}")
    return QUERIES, ORACLE
