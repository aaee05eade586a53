"""Choosing the features that separate good from bad loans, for each source table."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, functions as F

from ..operators import relational as rel
from ..operators import stats
from ..operators.cleaning import fill_nulls
from ..operators.quality import filled_columns
from ..sources.tables import materialized


@dataclass(frozen=True)
class Preset:
    """How one source table is tested."""

    filled: float = 0.7  # least non-null share
    fill: float | str = 0
    bootstrap: bool = True
    rule: str = ">"
    ignore: tuple[str, ...] = ("sk_id_curr", "target")
    row_id: str = "sk_id_curr"


# The settings of the eight selections.
PRESETS = {
    "application": Preset(fill="median"),
    "bureau": Preset(ignore=("sk_id_curr", "sk_id_bureau", "target"), row_id="sk_id_bureau"),
    "bureau_balance": Preset(bootstrap=False, ignore=("sk_id_curr", "sk_id_bureau", "target"), row_id="sk_id_bureau"),
    "credit_card": Preset(0.5, bootstrap=False, rule="any", ignore=("sk_id_curr", "sk_id_prev", "target"), row_id="sk_id_prev"),
    "installments": Preset(ignore=("sk_id_curr", "sk_id_prev", "target")),
    "previous_application": Preset(ignore=("sk_id_curr", "sk_id_prev", "target"), row_id="sk_id_prev"),
    "pos_cash": Preset(fill="median", bootstrap=False, ignore=("sk_id_curr", "sk_id_prev", "target"), row_id="sk_id_prev"),
    "all_features": Preset(
        0.5, "mean", rule=">=", ignore=("sk_id_curr", "target", "ext_source_1", "ext_source_2", "ext_source_3")
    ),
}


def significant_features(df: DataFrame, preset: Preset, iterations: int = 1000, seed: int = 123) -> DataFrame:
    """``(feature, test, vote, keep)`` for every sufficiently filled column of a labelled table.

    Missing numbers are filled in the feature only, never in the target.
    """
    labelled = materialized(df.filter(F.col("target").isNotNull()), "labelled")
    numeric, categorical = filled_columns(labelled, preset.filled, preset.ignore)
    votes = []
    if numeric:
        filled = fill_nulls(labelled, preset.fill, None, numeric)
        normal = {r["feature"] for r in stats.normal_features(filled, numeric).filter("normal").collect()}
        tests = [
            ("t_test", [c for c in numeric if c in normal], stats.t_test),
            ("mann_whitney", [c for c in numeric if c not in normal], stats.mann_whitney),
        ]
        for name, columns, test in tests:
            if columns:
                votes.append((name, test(filled, columns)))
        if preset.bootstrap:
            found = stats.bootstrap_diff(filled, preset.row_id, numeric, iterations=iterations, seed=seed)
            votes.append(("bootstrap", found))
    if categorical:
        votes.append(("chi_squared", stats.chi_squared(labelled, categorical)))
    table = None
    for name, found in votes:
        part = found.select("feature", F.lit(name).alias("test"), F.col("significant").alias("vote"))
        table = part if table is None else table.unionByName(part)
    if table is None:
        return df.sparkSession.createDataFrame([], "feature string, test string, vote int, keep int")
    table = materialized(table, "tests")  # a few rows, read twice; the tests behind them are run once
    kept = stats.feature_vote(table, preset.rule).select("feature", "keep")
    return table.join(kept, "feature")


def select_from_sources(tables: dict[str, DataFrame], presets: dict[str, Preset] = PRESETS, iterations: int = 1000, seed: int = 123) -> DataFrame:
    """(source, feature, test, vote, keep) of several source tables, selected side by side.

    Each source is read once; the small jobs of one fill the gaps of another.
    """
    def one(name: str) -> DataFrame:
        found = significant_features(tables[name], presets[name], iterations, seed)
        return materialized(found.withColumn("source", F.lit(name)), "votes")

    with ThreadPool(len(tables)) as pool:
        parts = pool.map(one, tables)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def source_tables(app, bur, bur_bal, cards, prev, inst, pos) -> dict[str, DataFrame]:
    """Each source table with its target, as the selections read it."""
    keys = app.select("sk_id_curr", "target")
    known = keys.filter(F.col("target").isNotNull())
    bridge = bur.select("sk_id_bureau", "sk_id_curr")
    return {
        "application": app,
        "bureau": rel.attach_target(bur, keys),
        "bureau_balance": rel.attach_target(rel.bridge_keys(bur_bal, bridge, "sk_id_bureau", ["sk_id_curr"], "inner"), keys),
        "credit_card": rel.attach_target(rel.bridge_keys(cards, prev, "sk_id_prev", ["sk_id_curr"]), keys),
        "installments": rel.max_per_client(known, prev, inst),
        "previous_application": rel.attach_target(prev, keys),
        "pos_cash": rel.attach_target(pos, keys, how="inner"),
    }


def kept_columns(selection: DataFrame) -> list[str]:
    rows = selection.filter(F.col("keep") == 1).select("feature").distinct().collect()
    return sorted(r["feature"] for r in rows)


def compose_features(whole: DataFrame, preset: Preset = PRESETS["all_features"], iterations: int = 1000) -> DataFrame:
    """The assembled table reduced to id, target, external sources and the significant features."""
    table = materialized(whole, "assembled")
    always = ["sk_id_curr", "target", "ext_source_1", "ext_source_2", "ext_source_3"]
    kept = set(kept_columns(significant_features(table, preset, iterations)))
    return table.select(*always, *[F.col(f"`{c}`") for c in table.columns if c in kept])
