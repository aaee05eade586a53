"""Operators for training-data pipelines. Nothing else in the package imports this one."""

from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
