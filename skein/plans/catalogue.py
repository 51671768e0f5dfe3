"""Every query of the engine, with the plain SQL it must agree with where SQL can say it."""

from __future__ import annotations

from skein.plans import corpus, evaluation, mixtures, schemas, tokens  # noqa: F401
from skein.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
