"""All queries of this package."""

import importlib

from .common import ORACLES, QUERIES

for _m in ("url_filter", "license_scan", "quality_knn", "near_dedup", "pii", "chat_format", "lm_score", "quality_rules", "decontaminate", "mixing", "whitening", "filter_audit", "imatch"):
    importlib.import_module(f"{__package__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
