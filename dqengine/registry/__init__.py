"""All registered queries."""

from dqengine.registry import audits, searches, tabular, textual  # noqa: F401
from dqengine.registry.base import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
