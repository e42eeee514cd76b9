"""Named query catalogue: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import importlib

from payscope.plans.registry import ORACLE, QUERIES

_MODULES = ["q_reports", "q_clean", "q_features", "q_stats", "q_ml", "q_routing", "q_monitor", "q_io_stream"]
_loaded = False


def _load():
    global _loaded
    if _loaded:
        return
    for m in _MODULES:
        try:
            importlib.import_module(f"payscope.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"payscope.plans.{m}":
                raise
    _loaded = True


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
