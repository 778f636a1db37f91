"""All registered queries, in inventory order."""

from __future__ import annotations

import importlib

from evidex.plans.registry import ORACLES, QUERIES

FAMILIES = (
    "sources", "vectors", "windows", "ranking", "timeline", "places", "evaluation", "objects",
    "records", "streams",
)
for _family in FAMILIES:
    importlib.import_module(f"evidex.plans.{_family}")


def queries():
    return dict(sorted(QUERIES.items()))


def oracle_sql():
    return dict(sorted(ORACLES.items()))
