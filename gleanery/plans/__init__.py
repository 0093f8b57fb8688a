"""The registered queries, by family."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text_scalars", "ranking", "relational", "evidence_queries", "streams", "selection_queries", "decision_queries", "identity_queries", "record_queries", "composed_queries", "bibliography_queries")


def load() -> None:
    """Import every family once; importing registers its queries."""
    for name in MODULES:
        importlib.import_module(f"gleanery.plans.{name}")
