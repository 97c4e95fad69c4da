"""Registered queries: a Spark plan and its SQL statement side by side."""

from __future__ import annotations


def catalogue():
    """All registered queries by key."""
    from factweave.plans import registry
    from factweave.plans import (  # noqa: F401  (importing registers the queries)
        periods, quality, asof, merges, normalise, text, evidence, strategy, streams, jobs, company,
    )

    return registry.all_queries()
