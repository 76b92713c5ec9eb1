"""All registered queries and their SQL."""

from . import dataset_queries  # noqa: F401  registers its own
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
