"""Every query by name, with the SQL text that checks it where SQL can."""

from . import aggregates, decisions, features, models, quality, relational, scalars, sources, stats  # noqa: F401
from . import assembly  # noqa: F401 - after the queries whose check texts it joins
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
