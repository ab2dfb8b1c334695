"""Queries over the given tables, each with an independent SQL statement where one exists."""

from workload import analytics, cleaning, metadata, profiling, questions, sources, time_series  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
