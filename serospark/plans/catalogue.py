"""Loads every query module; the registry is complete after this import."""

from serospark.plans import assay_queries, model_queries, normalise_queries, pair_queries, report_queries, sequence_queries, source_queries  # noqa: F401
from serospark.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
