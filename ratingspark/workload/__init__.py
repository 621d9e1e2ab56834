"""The registered queries over the given tables."""

from ratingspark.workload import models, studies, tables  # noqa: F401
from ratingspark.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
