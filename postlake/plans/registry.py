"""Every registered query of the library and its oracle SQL."""

from __future__ import annotations

from postlake.plans import aggregates, catalogues, connectors, eligibility, normalisation, relations, states  # noqa: F401  each module registers its queries
from postlake.plans.base import ORACLES, QUERIES  # noqa: F401
