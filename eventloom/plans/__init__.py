"""Registered queries, by area."""

from __future__ import annotations

import importlib

AREAS = ("mining", "streams", "relational", "scalar", "changes", "search")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"eventloom.plans.{area}")
