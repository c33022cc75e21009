"""Named queries over the sample tables."""

from __future__ import annotations

from spectroloom.plans import evidence, filters, joins, scalars, sequences, sources, spectral, streams, summaries, windows
from spectroloom.plans.registry import QUERIES, SQL

__all__ = ["evidence", "filters", "joins", "scalars", "sequences", "sources", "spectral", "streams", "summaries", "windows"]


def flagship(spark, sf_dir):
    """Best row of each scan with q-values by target and decoy."""
    return QUERIES["fdr_q_values"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
