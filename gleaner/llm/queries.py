"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from gleaner.llm.registry import ORACLES, QUERIES

MODULES = ("suffixes", "tokenids", "packing", "bpe", "media", "ngramjoin", "htmltext", "quality", "lm", "fingerprints", "simhash", "dialogues", "collocations")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"gleaner.llm.{name}")
    return QUERIES, ORACLES
