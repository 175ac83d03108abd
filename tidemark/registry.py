"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from .plans import extras, kernels, leaks, lifecycles, models, reports, studies, writes  # noqa: F401  each module registers its queries
from .plans.registrar import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
