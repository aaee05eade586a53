"""Six-statistic profiles per card, over all months and relative to recent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import col, ratio, zero_filled_sum
from .lookup import GROUP_ROWS, split_by_size
from .ordered import exact_quantiles

STATS = ("min", "max", "median", "mean", "sum", "std")
PERIODS = (1, 3)


def _stats(c: str, present: Column | None, approximate: bool, builtin_median: bool) -> dict[str, Column]:
    x = col(c)
    total = zero_filled_sum(x)
    out = {
        "min": F.min(x), "max": F.max(x), "mean": F.avg(x),
        "sum": total if present is None else F.when(present, total),
        "std": F.stddev_samp(x),
    }
    if approximate:
        out["median"] = F.percentile_approx(x.cast("double"), F.lit(0.5))
    elif builtin_median:
        out["median"] = F.median(x)
    return out


def _profile(df, key, columns, periods, month, approximate, limit) -> DataFrame:
    """Statistics of every column and, per period, of its values in the last n months."""
    cells, present = {c: col(c) for c in columns}, {}
    for n in periods:
        recent = col(month).between(-n, -1)
        cells.update({f"{c}_last{n}m": F.when(recent, col(c)) for c in columns})
        present[n] = recent
    source = df.filter(col(key).isNotNull()).select(
        key, *[x.alias(c) for c, x in cells.items()], *[p.alias(f"_in{n}") for n, p in present.items()]
    )

    def aggregate(part: DataFrame, builtin_median: bool) -> DataFrame:
        out = []
        for c in cells:
            inside = None
            for n in periods:
                if c.endswith(f"_last{n}m") and c not in columns:
                    inside = F.count(F.when(F.col(f"_in{n}"), 1)) > 0
            out += [v.alias(f"{c}_{s}") for s, v in _stats(c, inside, approximate, builtin_median).items()]
        return part.groupBy(key).agg(*out)

    if approximate:
        return aggregate(source, False)
    small, large = split_by_size(source, [key], limit)
    result = aggregate(small, True)
    if large is not None:
        medians = exact_quantiles(large, [key], list(cells), [0.5], limit=0)
        medians = medians.select(key, *[F.col(f"`{c}`")[0].alias(f"{c}_median") for c in cells])
        result = result.unionByName(aggregate(large, False).join(medians, key, "left"))
    return result


def six_stat_profile(
    df: DataFrame, key: str, columns: list[str], approximate: bool = False, limit: int = GROUP_ROWS
) -> DataFrame:
    """Minimum, maximum, median, mean, sum and deviation of every column per key."""
    out = _profile(df, key, columns, (), None, approximate, limit)
    return out.select(key, *[f"{c}_{s}" for c in columns for s in STATS])


def period_ratio_profile(
    df: DataFrame, key: str, columns: list[str], periods: tuple[int, ...] = PERIODS,
    month: str = "months_balance", approximate: bool = False, limit: int = GROUP_ROWS,
    with_profile: bool = False,
) -> DataFrame:
    """All-time statistic over the statistic of the last n months, per column and period."""
    out = _profile(df, key, columns, periods, month, approximate, limit)
    ratios = [
        ratio(f"{c}_{s}", f"{c}_last{n}m_{s}", "inf").alias(f"part_all_{c}_{s}_to_{n}M")
        for n in periods for c in columns for s in STATS
    ]
    profile = [f"{c}_{s}" for c in columns for s in STATS] if with_profile else []
    return out.select(key, *profile, *ratios)


def card_features(df: DataFrame, key: str = "sk_id_prev", ignore=("sk_id_curr", "months_balance", "name_contract_status")) -> DataFrame:
    """Profile and period ratios of every numeric card column."""
    columns = [c for c in df.columns if c not in (*ignore, key)]
    return period_ratio_profile(df, key, columns, with_profile=True)


def card_features_by_client(features: DataFrame, bridge: DataFrame, key: str = "sk_id_prev", client: str = "sk_id_curr") -> DataFrame:
    """Card features averaged over the cards of a client, whose id comes from the bridge."""
    columns = [c for c in features.columns if c != key]
    joined = features.join(bridge.select(key, client).filter(col(client).isNotNull()), key, "inner")
    return joined.groupBy(client).agg(*[F.avg(col(c)).alias(c) for c in columns])
