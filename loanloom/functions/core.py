"""Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def ratio(num: str | Column, den: str | Column, on_zero: float | str | None = None) -> Column:
    """``num / den`` as double without raising on a zero denominator.

    0/0 is NULL. A non-zero numerator over zero gives NULL by default, a signed
    infinity for ``on_zero="inf"``, or the given number.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    plain = F.try_divide(n, d)
    if on_zero is None:
        return plain
    if on_zero == "inf":
        return (
            F.when((d == 0) & (n > 0), F.lit(INF))
            .when((d == 0) & (n < 0), F.lit(-INF))
            .otherwise(plain)
        )
    return F.when((d == 0) & (n != 0), F.lit(float(on_zero))).otherwise(plain)


def holds(condition: Column) -> Column:
    """A condition under which unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def whole_div(c: str | Column, by: int) -> Column:
    """Integer quotient truncated toward zero."""
    return (col(c) / by).cast("bigint")


def zero_filled_sum(c: Column) -> Column:
    """Sum that is 0, not NULL, over a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def settled(c: str | Column, digits: int) -> Column:
    """Rounded, after dropping the last bits that depend on the order of a sum."""
    return F.round(F.round(col(c), 9), digits)


def hash_word(id_col: str | Column, salt: str | int, word: int = 0) -> Column:
    """A 32-bit unsigned number (as bigint) that depends only on the id and salt.

    Splits, folds and bootstrap weights are built on it, so they do not move
    when the data is partitioned in another way or a task is run again.
    """
    digest = F.md5(F.concat_ws("#", col(id_col).cast("string"), F.lit(str(salt))).cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def is_categorical(dtype: str) -> bool:
    """Text and boolean columns are categorical, everything else numerical."""
    return dtype in ("string", "boolean") or dtype.startswith(("varchar", "char"))


def column_kinds(df, ignore=()) -> tuple[list[str], list[str]]:
    """(numerical, categorical) column names read off the schema alone."""
    skip = {c.lower() for c in ignore}
    numeric, categorical = [], []
    for name, dtype in df.dtypes:
        if name.lower() not in skip:
            (categorical if is_categorical(dtype) else numeric).append(name)
    return numeric, categorical
