"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import os

GROUPS = ["profiling", "validation", "healing", "privacy", "metadata", "files"]


def all_queries():
    from queries.registry import ORACLES, QUERIES

    here = os.path.dirname(__file__)
    for group in GROUPS:
        if os.path.exists(os.path.join(here, f"{group}.py")):
            importlib.import_module(f"queries.{group}")
    return QUERIES, ORACLES
