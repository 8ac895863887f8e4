"""Every query the library answers over the given tables, registered by topic."""

from __future__ import annotations

import importlib

TOPICS = ("duplicates", "filters", "folders", "titles", "planning", "fingerprints", "streaming", "sources", "refreshing")


def load_all():
    """(queries, oracles) of all topics."""
    from .common import ORACLES, QUERIES

    for topic in TOPICS:
        importlib.import_module(f"{__name__}.{topic}")
    return QUERIES, ORACLES
