"""The registry of the library's own queries and their DuckDB counterparts."""

from __future__ import annotations

from seasonflow.plans import learners, metrics, patterns, regime, scans, selection, streams, timeseries, trades

MODULES = [scans, timeseries, regime, patterns, selection, trades, metrics, learners, streams]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: text for m in MODULES for name, text in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """The daily book, from bars to drawdowns."""
    return QUERIES["flagship_book"](spark, sf_dir)
