"""Registration of queries next to their checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.standin import VIEWS, Views, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(text: str) -> str:
    """Put the stand-in views a statement names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text, re.IGNORECASE)]
    parts = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    body = text.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of the views under ``name``."""
    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column, so that sums in another order compare equal."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), special.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])
