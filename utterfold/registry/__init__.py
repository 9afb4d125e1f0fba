"""Registered queries over the driver tables and their SQL."""

from . import drift, files, labels, metrics, models, plans, profile, scores, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
