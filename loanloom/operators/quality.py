"""Key, reference and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import col, column_kinds, is_categorical
from .ordered import exact_quantiles

SKETCH_BITS = 12  # standard error of a distinct-count sketch: 1.6 %
NEAR_UNIQUE = 0.8  # twelve standard errors below full uniqueness


def unique_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: rows, missing values, and whether it could be a key.

    Two jobs for all tables together. A sketch pass rules out columns that are far from
    unique; each column left is then grouped by itself, and one repeated value refutes it.
    """
    sketches = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), *[
            F.struct(F.count(col(c)).alias("known"), F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(col(c)), SKETCH_BITS)).alias("distinct")).alias(f"_{i}")
            for i, c in enumerate(df.columns)])
        one = row.select(F.lit(name).alias("table"), "n", F.array(*[f"_{i}" for i in range(len(df.columns))]).alias("columns"))
        sketches = one if sketches is None else sketches.unionByName(one)
    found = {r["table"]: r for r in sketches.collect()}
    repeated = None
    for name, df in tables.items():
        row = found[name]
        for c, x in zip(df.columns, row["columns"]):
            if x["known"] == row["n"] and x["distinct"] >= NEAR_UNIQUE * row["n"]:
                twice = df.groupBy(col(c).alias("value")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
                one = twice.agg(F.count(F.lit(1)).alias("values")).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "values")
                repeated = one if repeated is None else repeated.unionByName(one)
    keys = {(r["table"], r["column"]) for r in repeated.collect() if not r["values"]} if repeated is not None else set()
    out = [(name, c, found[name]["n"], found[name]["n"] - x["known"], (name, c) in keys)
           for name, df in tables.items() for c, x in zip(df.columns, found[name]["columns"])]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        out, "table_name string, column_name string, n_rows long, n_missing long, is_unique boolean"
    )


def _orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    keys = child.select(col(key).alias(key)).filter(col(key).isNotNull()).distinct()
    owners = parent.select(col(parent_key or key).alias(key))
    return keys.join(owners, key, "left_anti")


def fk_subset_check(relations: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """``(relation, n_orphans, ok)``: keys of a child table that its parent lacks."""
    parts = None
    for name, (child, parent, key) in relations.items():
        one = _orphan_keys(child, parent, key).agg(F.count(F.lit(1)).alias("n_orphans")).select(
            F.lit(name).alias("relation"), "n_orphans", (F.col("n_orphans") == 0).alias("ok")
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def fk_drop_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_semi")


def null_shares(df: DataFrame, ignore=()) -> DataFrame:
    """``(column_name, share, kind)``: non-null share of every column in one pass."""
    skip = {c.lower() for c in ignore}
    kinds = [(c, "categorical" if is_categorical(t) else "numerical") for c, t in df.dtypes if c.lower() not in skip]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.try_divide(F.col(f"`{c}`").cast("double"), F.col("_rows")).alias("share"),
            F.lit(kind).alias("kind"),
        )
        for c, kind in kinds
    ])
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(col(c)).alias(c) for c, _ in kinds])
    return counts.select(F.explode(cells).alias("r")).select("r.*")


def null_ratio_select(df: DataFrame, p: float = 0.7, ignore=()) -> DataFrame:
    """The columns whose non-null share is at least ``p``."""
    return null_shares(df, ignore).filter(F.col("share") >= p)


def filled_columns(df: DataFrame, p: float, ignore=()) -> tuple[list[str], list[str]]:
    """Names of sufficiently filled (numerical, categorical) columns; one row per column is read."""
    rows = null_ratio_select(df, p, ignore).collect()
    numeric = [r["column_name"] for r in rows if r["kind"] == "numerical"]
    return numeric, [r["column_name"] for r in rows if r["kind"] == "categorical"]


def column_kinds_table(df: DataFrame, ignore=()) -> DataFrame:
    """``(column_name, kind)`` without reading data."""
    numeric, categorical = column_kinds(df, ignore)
    rows = [(c, "numerical") for c in numeric] + [(c, "categorical") for c in categorical]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")


def table_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, missing, mean, deviation, minimum, quartiles and maximum per numeric column."""
    columns = columns or [c for c in column_kinds(df)[0] if dict(df.dtypes)[c] not in ("date", "timestamp")]
    parts = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        x = col(c).cast("double")
        parts += [
            F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
        ]
    quartiles = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75]).first()
    row = df.agg(*parts).first()
    out = []
    for c in columns:
        q = quartiles[c] or [None] * 3
        n = row[f"{c}__n"]
        out.append((c, n, row["_rows"] - n, row[f"{c}__mean"], row[f"{c}__std"], row[f"{c}__min"], *q, row[f"{c}__max"]))
    return df.sparkSession.createDataFrame(
        out,
        "column_name string, n long, n_missing long, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double",
    )


def null_count(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    counts = [F.count(F.when(col(c).isNull(), 1)).alias(f"{c}_missing") for c in columns]
    return df.groupBy(by).agg(*counts) if by else df.agg(*counts)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, a missing one included."""
    return df.select(column).distinct()
