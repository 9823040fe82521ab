"""All registered queries."""

from bugsieve.plans import queries_stats, queries_tables, queries_text, queries_vectors  # noqa: F401
from bugsieve.plans.registry import CHECKS, QUERIES  # noqa: F401
