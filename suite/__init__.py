"""All registered queries."""

import importlib

from .registry import ORACLES, QUERIES

for _m in ["text", "sources", "structure", "clauses", "retrieval", "vectors", "compare", "rules", "issues", "registry_ops", "runs", "metrics", "state", "streams", "jobs"]:
    try:
        importlib.import_module(f".{_m}", __name__)
    except ModuleNotFoundError as e:
        if e.name != f"{__name__}.{_m}":
            raise

__all__ = ["QUERIES", "ORACLES"]
