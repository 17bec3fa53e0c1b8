"""Joins and row expressions over tables of any origin: a family's columns onto games, slugs, overtime columns, orders along asks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_columns(table: DataFrame, other: DataFrame) -> list[str]:
    """Columns of ``other`` that ``table`` lacks, in their order."""
    return [c for c in other.columns if c not in table.columns]


def join_family(games: DataFrame, family: DataFrame, side: str, suffix: str, team: str = "teamId", keys: tuple[str, ...] = ("gameId", "season")) -> DataFrame:
    """Games with the family's own columns for the team in ``side``, each with the suffix; games without a row get nulls.

    Only columns that the games lack come along.
    """
    mine = [c for c in new_columns(games, family) if c not in (team, *keys)]
    named = family.select(*keys, F.col(team).alias(side), *[F.col(c).alias(f"{c}_{suffix}") for c in mine])
    return games.join(named, [*keys, side], "left").select(*games.columns, *[f"{c}_{suffix}" for c in mine])


def overtime_count(table: DataFrame, pattern: str = r"^PTS_OT\d+$") -> Column:
    """How many overtime columns of the row are filled in with something."""
    filled = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1).otherwise(0) for c in table.columns if re.match(pattern, c)]
    return F.coalesce(sum(filled[1:], filled[0]) if filled else F.lit(0), F.lit(0))


def with_slugs(games: DataFrame, abbreviations: DataFrame, prefix: str = "game") -> DataFrame:
    """Games with ``slug``: prefix, the visitor's and the home team's abbreviation of that season, and the date.

    ``abbreviations`` has city, name, season and abbreviation; a team that it lacks leaves the slug null.
    """
    out = games
    for side in ("hometeam", "awayteam"):
        names = abbreviations.select(F.col("city").alias(f"{side}Prename"), F.col("name").alias(f"{side}Name"), "season", F.lower("abbreviation").alias(f"_{side}"))
        out = out.join(names, [f"{side}Prename", f"{side}Name", "season"], "left")
    slug = F.concat(F.lit(f"{prefix}-"), F.col("_awayteam"), F.lit("-"), F.col("_hometeam"), F.lit("-"), F.date_format("gameDate", "yyyy-MM-dd"))
    return out.withColumn("slug", slug).select(*games.columns, "slug")


def orders(p: Column, asks: Column, budget: float, least_edge: float = 0.0) -> Column:
    """Orders along ``asks`` (structs of price and size, best first): [(price, shares)].

    At each price above whose odds the fair odds lie by more than ``least_edge``, (p - price) / price of what is left of
    the budget is put in, in whole shares.  Where the ask holds them, the walk ends; where it does not, all of it is taken
    and paid, and the walk goes on.
    """
    start = F.struct(F.lit(float(budget)).alias("left"), F.lit(True).alias("on"), F.array().cast("array<struct<price:double,shares:double>>").alias("got"))

    def step(state: Column, ask: Column) -> Column:
        price, size = ask["price"].cast("double"), ask["size"].cast("double")
        edge = F.rint((p - price) / price * 100) / 100
        want = F.floor(edge * state["left"] / price).cast("double")
        go = state["on"] & (1 / price - 1 / p > least_edge)
        short = want > size
        take = F.when(short, size).otherwise(want)
        got = F.concat(state["got"], F.array(F.struct(price.alias("price"), take.alias("shares"))))
        return F.struct(
            F.when(go & short, state["left"] - size * price).otherwise(state["left"]).alias("left"), (go & short).alias("on"), F.when(go, got).otherwise(state["got"]).alias("got")
        )

    return F.aggregate(asks, start, step, lambda s: s["got"])
