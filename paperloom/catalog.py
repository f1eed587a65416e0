"""All queries of the engine's own operators, by name, with the SQL that gives the same rows."""

from paperloom.plans import agenda, graph, identity, messages, reading, replies, retrieval, upkeep  # noqa: F401
from paperloom.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
