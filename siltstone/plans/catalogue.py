"""All queries of the catalogue."""

from siltstone.plans import code, events, graphs, incremental, records, rules, streams, tables, texts  # noqa: F401  they register their queries
from siltstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
