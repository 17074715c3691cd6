"""The queries of this subpackage, complete once this module is imported."""

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
