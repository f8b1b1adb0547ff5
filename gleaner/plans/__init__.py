"""Registered queries, by family."""

from __future__ import annotations

import importlib
import pkgutil

from gleaner.plans.registry import ORACLES, QUERIES


def load_all():
    """Import every plan module (each registers its queries) and return (queries, oracles)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_plans"):
            importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
