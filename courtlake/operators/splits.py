"""Splits of exact size without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows are ranked within hash ranges; only the ranges' counts meet in one task.
RANGE_BITS = 12


def shuffled_rank(table: DataFrame, key: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_rank`` (from 1) and ``_size`` within each group of ``by``, in the order of a seeded hash of the key.

    Rows are sorted per hash range.  The ranges' counts, at most 2**RANGE_BITS
    rows a group, are the only rows that one task gets per group.
    """
    hashed = table.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    hashed = hashed.withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGE_BITS))
    order = Window.partitionBy(*by).orderBy("_range")
    counts = hashed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    counts = counts.withColumn("_size", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    inner = Window.partitionBy(*by, "_range").orderBy("_hash", key)
    ranked = hashed.withColumn("_rank", F.row_number().over(inner))
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_range")]
    condition = null_safe[0]
    for more in null_safe[1:]:
        condition &= more
    joined = ranked.alias("r").join(counts.alias("c"), condition)
    columns = [F.col(f"r.{c}") for c in table.columns]
    return joined.select(*columns, (F.col("c._before") + F.col("r._rank")).alias("_rank"), F.col("c._size").alias("_size"))


def random_split(table: DataFrame, key: str, test: float = 0.2, val: float = 0.2, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``split``: of each group of ``by``, ceil(test) of the rows, then ceil(val) of all rows, the rest to train."""
    ranked = shuffled_rank(table, key, seed, by)
    n_test = F.ceil(F.round(F.col("_size") * test, 9))
    n_val = F.ceil(F.round(F.col("_size") * val, 9))
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank", "_size")


def expanding_folds(table: DataFrame, date: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) pairs: each trains on all days before its validation days; the days' counts cut the table evenly.

    Rows of one day stay together, so no fold learns from the day that it predicts.
    """
    days = table.groupBy(date).agg(F.count("*").alias("n")).orderBy(date).toPandas()  # a row per day
    share = (days["n"].cumsum() - days["n"]) / days["n"].sum()
    edges = [days[date][share >= k / (folds + 1)].min() for k in range(1, folds + 1)] + [None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = F.col(date) >= F.lit(lo)
        out.append((table.filter(F.col(date) < F.lit(lo)), table.filter(inside if hi is None else inside & (F.col(date) < F.lit(hi)))))
    return out


def k_folds(table: DataFrame, key: str, folds: int, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) pairs of a seeded deal: every row is in one validation part, whose sizes differ by one row at most."""
    dealt = shuffled_rank(table, key, seed).withColumn("_fold", F.pmod(F.col("_rank"), F.lit(folds))).drop("_rank", "_size")
    return [(dealt.filter(F.col("_fold") != k).drop("_fold"), dealt.filter(F.col("_fold") == k).drop("_fold")) for k in range(folds)]
