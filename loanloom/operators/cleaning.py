"""Filling, replacing, narrowing and encoding of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import INF, col, column_kinds
from .bureau import category_values
from .ordered import exact_quantiles

MISSING_TEXT = "<missing>"
MISSING_NUMBER = -999
INT16 = (-32768, 32767)


def fill_nulls(
    df: DataFrame, numeric: float | str | None = MISSING_NUMBER, text: str | None = MISSING_TEXT, columns=None
) -> DataFrame:
    """Fill numbers with a constant, ``"mean"`` or ``"median"``, and text with a constant.

    Means and medians of all columns come from one row computed beforehand.
    """
    columns = df.columns if columns is None else list(columns)
    numbers, texts = column_kinds(df.select(*columns))
    fills: dict[str, object] = {}
    if numeric == "mean" and numbers:
        row = df.agg(*[F.avg(col(c)).alias(c) for c in numbers]).first()
        fills.update({c: row[c] for c in numbers})
    elif numeric == "median" and numbers:
        row = exact_quantiles(df, [], numbers, [0.5]).first()
        fills.update({c: row[c][0] for c in numbers if row[c]})
    elif numeric is not None:
        fills.update({c: numeric for c in numbers})
    if text is not None:
        types = dict(df.dtypes)
        fills.update({c: text for c in texts if types[c] != "boolean"})
    types = dict(df.dtypes)

    def filled(c: str) -> Column:
        value = fills.get(c)
        if value is None:
            return col(c)
        kind = types[c]
        # a fractional mean or median must not be cut off in a whole-number column
        if kind in ("tinyint", "smallint", "int", "bigint") and float(value) != int(value):
            kind = "double"
        return F.coalesce(col(c).cast(kind), F.lit(value).cast(kind)).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def replace_infinite(df: DataFrame, columns: list[str], value: float) -> DataFrame:
    def finite(c: str) -> Column:
        return F.when(F.abs(col(c)) == INF, float(value)).otherwise(col(c)).alias(c)
    return df.select(*[finite(c) if c in columns else col(c) for c in df.columns])


def cast_columns(df: DataFrame, spec: dict[str, str], safe: bool = False) -> DataFrame:
    """Change column types; a text column cast to ``date`` is read as yyyy-MM-dd."""
    def changed(c: str, dtype: str) -> Column:
        if c not in spec:
            return col(c)
        if spec[c] == "date" and dtype == "string":
            return F.to_date(col(c), "yyyy-MM-dd").alias(c)
        x = col(c).try_cast(spec[c]) if safe else col(c).cast(spec[c])
        return x.alias(c)
    return df.select(*[changed(c, t) for c, t in df.dtypes])


def bool_from_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text '1' is true, everything else false."""
    return df.select(*[
        F.coalesce(col(c).cast("string") == "1", F.lit(False)).alias(c) if c in columns else col(c)
        for c in df.columns
    ])


def snake_case_columns(df: DataFrame, mode: str = "all") -> DataFrame:
    """Replace characters in column names with ``_``.

    ``all`` replaces everything but letters and digits and lower-cases;
    ``punctuation`` keeps letters, digits, ``_`` and white space and the case.
    """
    if mode == "all":
        names = [re.sub("[^a-zA-Z0-9]", "_", c).lower() for c in df.columns]
    else:
        names = [re.sub(r"[^\w\s]", "_", c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"column names collide after renaming: {sorted(names)}")
    return df.toDF(*names)


def narrow_type_plan(df: DataFrame, reference_order: bool = False) -> dict[str, str]:
    """Smallest type per column, from one aggregate over the table.

    Wholeness is tested before the 16-bit range, so fractions stay fractions;
    ``reference_order`` tests the range first.
    """
    numbers, texts = column_kinds(df)
    texts = [c for c in texts if dict(df.dtypes)[c] == "string"]
    numbers = [c for c in numbers if dict(df.dtypes)[c] not in ("date", "timestamp")]
    parts = []
    for c in numbers:
        x = col(c).cast("double")
        parts += [
            F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
            F.coalesce(F.bool_and(x == F.round(x)), F.lit(True)).alias(f"{c}__whole"),
            F.coalesce(F.bool_and(x.isin(0.0, 1.0)), F.lit(False)).alias(f"{c}__flag"),
        ]
    for c in texts:
        parts += [
            F.coalesce(F.bool_and(col(c).isin("Y", "N")), F.lit(False)).alias(f"{c}__yn"),
            F.coalesce(F.bool_or(col(c) == "Y") & F.bool_or(col(c) == "N"), F.lit(False)).alias(f"{c}__both"),
        ]
    row = df.agg(*parts).first()
    plan = {}
    for c, dtype in df.dtypes:
        if c in numbers:
            lo, hi, whole = row[f"{c}__min"], row[f"{c}__max"], row[f"{c}__whole"]
            in_range = lo is not None and lo >= INT16[0] and hi <= INT16[1]
            if row[f"{c}__flag"] and lo == 0 and hi == 1:
                plan[c] = "boolean"
            elif in_range and (whole or reference_order):
                plan[c] = "smallint"
            elif whole:
                plan[c] = "int" if lo is None or (lo >= -(2**31) and hi < 2**31) else "bigint"
            else:
                plan[c] = "float"
        elif c in texts:
            plan[c] = "boolean" if row[f"{c}__yn"] and row[f"{c}__both"] else "string"
        else:
            plan[c] = dtype
    return plan


def narrow_types(df: DataFrame, plan: dict[str, str] | None = None, reference_order: bool = False) -> DataFrame:
    """The table cast to the smallest types."""
    plan = narrow_type_plan(df, reference_order) if plan is None else plan

    def narrowed(c: str, dtype: str) -> Column:
        if plan[c] == "boolean" and dtype == "string":
            return (col(c) == "Y").alias(c)
        return col(c).cast(plan[c]).alias(c)

    return df.select(*[narrowed(c, t) for c, t in df.dtypes])


def narrow_type_table(df: DataFrame, reference_order: bool = False) -> DataFrame:
    rows = list(narrow_type_plan(df, reference_order).items())
    return df.sparkSession.createDataFrame(rows, "column_name string, new_type string")


def one_hot(df: DataFrame, columns: list[str], drop: str | None = None, values: dict[str, list] | None = None) -> DataFrame:
    """Replace categorical columns by ``<column>_<value>`` flags (tinyint).

    ``drop`` is None, ``first`` or ``if_binary``. A missing value is a category
    of its own, last, named ``nan``.
    """
    open_ = [c for c in columns if not (values and c in values)]
    found: dict[str, list] = {c: [] for c in open_}
    if open_:  # the values of all columns in one pass
        cells = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in open_])
        for r in df.select(F.explode(cells).alias("x")).select("x.c", "x.v").distinct().collect():
            found[r.c].append(r.v)
    flags = []
    for c in columns:
        text = col(c).cast("string")
        if c in found:
            known, holes = sorted(v for v in found[c] if v is not None), None in found[c]
        else:
            known, holes = list(values[c]), False
        tests = [(f"{c}_{v}", F.coalesce(text == v, F.lit(False))) for v in known]
        if holes:
            tests.append((f"{c}_nan", col(c).isNull()))
        if drop == "first" or (drop == "if_binary" and len(tests) == 2):
            tests = tests[1:]
        flags += [t.cast("tinyint").alias(n) for n, t in tests]
    return df.select(*[col(c) for c in df.columns if c not in columns], *flags)


def standardize(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """z-scores with the mean and population deviation of ``fitted_on``."""
    source = df if fitted_on is None else fitted_on
    parts = [F.avg(col(c)).alias(f"{c}__m") for c in columns] + [F.stddev_pop(col(c)).alias(f"{c}__s") for c in columns]
    row = source.agg(*parts).first()

    def scaled(c: str) -> Column:
        mean, sd = row[f"{c}__m"], row[f"{c}__s"]
        if mean is None:
            return col(c).cast("double").alias(c)
        return ((col(c).cast("double") - mean) / (sd if sd else 1.0)).alias(c)

    return df.select(*[scaled(c) if c in columns else col(c) for c in df.columns])


def labelled_split(df: DataFrame, target: str = "target", cast: str = "int") -> tuple[DataFrame, DataFrame]:
    """(labelled rows with the target cast, unlabelled rows without it)."""
    labelled = df.filter(col(target).isNotNull())
    labelled = labelled.select(*[col(c).cast(cast).alias(c) if c == target else col(c) for c in df.columns])
    return labelled, df.filter(col(target).isNull()).drop(target)
