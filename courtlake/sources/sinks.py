"""Writers of tables, JSON drops and prompt sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.functions.scratch import cut


def save_table(table: DataFrame, path: str, append: bool = False) -> None:
    """Parquet; appended files leave the earlier ones alone."""
    table.write.mode("append" if append else "overwrite").parquet(path)


def save_by_key(table: DataFrame, path: str, key: str = "gameId") -> None:
    """JSON files in one folder per key; rows without a key are left out."""
    table.filter(F.col(key).isNotNull()).repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def save_by_flag(table: DataFrame, flag: str, path_if_set: str, path_otherwise: str) -> None:
    """Rows whose flag is 1, and those whose flag is 0; a null flag is in neither."""
    table.filter(F.col(flag) == 1).write.mode("overwrite").parquet(path_if_set)
    table.filter(F.col(flag) == 0).write.mode("overwrite").parquet(path_otherwise)


def upsert_latest(history: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("gameDate", "hometeamId", "awayteamId")) -> DataFrame:
    """History with the rows of the same date and teams replaced by the results; columns as in history.

    Of results that repeat a key, the one with the largest gameId stays.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gameId").desc_nulls_last()))
    newest = results.withColumn("_rank", first).filter("_rank = 1").drop("_rank")
    kept = history.join(newest.select(*keys), list(keys), "left_anti").select(*history.columns)
    return kept.unionByName(newest, allowMissingColumns=True).select(*history.columns)


def prompt_sets(table: DataFrame, prompt: str, order: str, train: float = 0.8, val: float = 0.9) -> DataFrame:
    """(``order``, text, split): prompts by their place along ``order``, the first 80 % to train, up to 90 % to val, the rest to test.

    Rows with a null in any column are left out.  Places are counted per range of a sort, so no task holds all rows.
    """
    ranked = table.na.drop("any").select(order, F.col(prompt).alias("text")).orderBy(order).withColumn("_at", F.monotonically_increasing_id())
    ranked = cut(ranked)
    ranges = ranked.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    along = Window.orderBy("_range")  # a row per task of the sort
    ranges = ranges.select("_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    placed = ranked.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges), "_range")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    split = F.when(place < F.rint(F.col("_rows") * train), "train").when(place < F.rint(F.col("_rows") * val), "validation").otherwise("test")
    return placed.select(order, "text", split.alias("split"))


def save_prompts(sets: DataFrame, path: str) -> None:
    """One JSON lines folder per split."""
    sets.write.mode("overwrite").partitionBy("split").json(path)
