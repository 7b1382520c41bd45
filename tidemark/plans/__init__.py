"""Named queries; importing this package registers them all."""

from tidemark.plans import analysis, evidence, extraction, interchange, mining, papers, resampling, surfaces  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
