"""Named queries over the given tables, each with a DuckDB twin where SQL can express it."""

from tagshift.catalog import (  # noqa: F401
    couplings,
    distances,
    histograms,
    kinematics,
    metrics,
    models,
    rows,
    storage,
    streams,
)
from tagshift.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
