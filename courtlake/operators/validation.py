"""Checks of a table before it is learnt from, each in one pass over the columns that it names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.operators.models import feature_kinds


def check_table(table: DataFrame, required: Sequence[str] = (), min_rows: int = 1, kinds: Mapping[str, str] | None = None) -> int:
    """Rows of the table; an error if there are fewer than ``min_rows``, a required column is absent, or a column is of another kind.

    ``kinds`` names Spark types by their beginning, such as ``decimal``; columns that the table lacks are passed over.
    """
    absent = [c for c in required if c not in table.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    types = dict(table.dtypes)
    wrong = {c: types[c] for c, k in (kinds or {}).items() if c in types and not types[c].startswith(k)}
    if wrong:
        raise ValueError(f"columns of another kind: {wrong}")
    n = table.count()
    if n < max(1, min_rows):
        raise ValueError(f"{n} rows, at least {max(1, min_rows)} are needed")
    return n


def check_target(table: DataFrame, target: str, min_per_class: int = 1) -> dict[object, int]:
    """Rows by class; an error if there are fewer than two classes, or one has too few rows.  Null is no class."""
    counts = {r[target]: r["n"] for r in table.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError(f"{len(counts)} classes, at least 2 are needed")
    if min(counts.values()) < min_per_class:
        raise ValueError(f"a class has {min(counts.values())} rows, at least {min_per_class} are needed")
    return counts


def check_features(table: DataFrame, numeric: Sequence[str] = (), category: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns by kind; an error if an expected one is absent or of the other kind."""
    found = feature_kinds(table)
    for kind, names in (("numeric", numeric), ("category", category)):
        lacking = sorted(set(names) - set(found[kind]))
        if lacking:
            raise ValueError(f"missing {kind} features: {lacking}")
    return found


def missing_summary(table: DataFrame, max_share: float | None = None) -> dict[str, tuple[int, float]]:
    """(nulls, share) of every column that has nulls; an error if a share is above ``max_share``."""
    row = table.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(table.columns)]).first()
    out = {c: (row[f"c{i}"], row[f"c{i}"] / row["n"]) for i, c in enumerate(table.columns) if row[f"c{i}"]}
    over = [c for c, (_, share) in out.items() if max_share is not None and share > max_share]
    if over:
        raise ValueError(f"too many nulls in {over}")
    return out


def check_splits(sizes: Mapping[str, int], least: int = 1) -> None:
    small = {k: n for k, n in sizes.items() if n < least}
    if small:
        raise ValueError(f"splits with fewer than {least} rows: {small}")
