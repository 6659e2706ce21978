"""All registered queries of the time-series part, with their DuckDB SQL."""

from __future__ import annotations

from tidewell.plans import benchmark, distributions, events, forecasting, joined, registry_features, resampled, selection, simulated, study_catalogue, trends, windows  # noqa: F401
from tidewell.plans.common import ORACLE_SQL, QUERIES

FLAGSHIP = "n22_scoreboard"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
