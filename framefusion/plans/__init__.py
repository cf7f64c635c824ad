"""Queries over the given tables."""

import importlib

from framefusion.plans.registry import ORACLES, QUERIES

MODULES = ("relations", "expressions", "generation", "grouping", "measures", "selection", "temporal", "learning",
           "pixels", "files")


def load() -> dict:
    for name in MODULES:
        try:
            importlib.import_module(f"framefusion.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"framefusion.plans.{name}":
                raise
    return QUERIES
