"""Registered queries over the driver's tables; importing this package fills the registry."""

from ..registry import ORACLES, QUERIES  # noqa: F401
from . import agent_q, consolidate_q, cycle_q, io_q, memory_q, pages_q, stream_q, working_q  # noqa: F401


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
