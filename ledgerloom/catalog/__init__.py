"""Named queries over the warehouse tables, each with its statement in plain SQL where one exists."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

_PARTS = ("columns", "ingest", "filters", "joins", "reports", "peers", "views", "ledgers", "statistics", "streams")


def load() -> None:
    """Import every part once so that all queries are registered."""
    for part in _PARTS:
        importlib.import_module(f"{__name__}.{part}")


__all__ = ["ORACLES", "QUERIES", "load"]
