"""All registered queries."""

from docloom.plans import (  # noqa: F401
    queries_html,
    queries_listings,
    queries_members,
    queries_names,
    queries_refs,
    queries_sequence,
    queries_sources,
    queries_text,
)
from docloom.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
