"""Queries over the tables, each with its SQL twin."""

from . import histories, joins, nests, rendering, reports, retrieval, scalars, statistics, stores  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
