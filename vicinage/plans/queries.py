"""All queries of the reference's operators, by inventory name."""

from . import aggregates, audits, integrity, neighbourhoods, resamples, verdicts  # noqa: F401  they register their queries
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
