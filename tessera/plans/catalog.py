"""All registered queries (importing the query modules fills the registry)."""
from __future__ import annotations

from . import q_clean, q_encode, q_explain, q_model, q_profile, q_submit  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
