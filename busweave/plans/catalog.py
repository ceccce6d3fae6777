"""Imports every query module, which fills the registry."""

from busweave.plans import (  # noqa: F401
    q_enrich,
    q_headway,
    q_integrated,
    q_learning,
    q_matching,
    q_profile,
    q_scalars,
    q_shaping,
    q_sources,
    q_stats,
    q_trajectory,
)
from busweave.plans.registry import QUERIES, SQL  # noqa: F401
