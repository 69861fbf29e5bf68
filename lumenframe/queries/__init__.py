"""Every query of the inventory by id, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from lumenframe.queries.registry import ORACLES, QUERIES

SECTIONS = (
    "profile",
    "projections",
    "nulls",
    "outliers",
    "encoding",
    "scaling",
    "selection",
    "joins",
    "aggregations",
    "windows",
    "functions",
    "splits",
    "training",
    "metrics",
    "recommend",
    "composites",
    "sources",
)

for _section in SECTIONS:
    importlib.import_module(f"lumenframe.queries.{_section}")

__all__ = ["ORACLES", "QUERIES"]
