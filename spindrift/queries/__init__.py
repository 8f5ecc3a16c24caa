"""Registered queries of the engine, each with its oracle SQL."""

import importlib

from spindrift.queries.registry import ORACLES, QUERIES

for _family in ("merging", "seasons", "tracks", "statistics", "images", "catalogues", "buoys", "matches", "files"):
    importlib.import_module(f"spindrift.queries.{_family}")
