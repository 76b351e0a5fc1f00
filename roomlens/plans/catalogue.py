"""All registered telemetry queries."""

from __future__ import annotations

from . import counterfactual, lookups, models, regions, rules, series, sound, studies, study, tracks  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "zone_biomarkers"
