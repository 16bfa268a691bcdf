"""Imports every query module, which registers its queries."""

import importlib

MODULES = ["quality_queries", "risk_queries", "stat_queries", "store_queries", "ml_queries"]


def load():
    for name in MODULES:
        importlib.import_module(f"workload.{name}")


load()
