"""All queries of the library's own operators."""

from mediagraph.plans import catalog, duplicates, grouping, lyrics, records, reporting, scalars, streams  # noqa: F401
from mediagraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
