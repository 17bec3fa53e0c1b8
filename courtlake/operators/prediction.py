"""Games to come: placeholders, features from history and slate together, and the columns that a fitted model expects."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.operators import models
from courtlake.operators.deltas import Group, Momentum, conference_features, create_deltas, create_momentum, filter_by_conference, resolve_features
from courtlake.plans.league import League

log = logging.getLogger(__name__)


def season_of(date: str):
    """Season of a date, such as 1999/00: it begins in September."""
    year = F.when(F.month(date) >= 9, F.year(date)).otherwise(F.year(date) - 1)
    return F.concat(year.cast("string"), F.lit("/"), F.right((year + 1).cast("string"), F.lit(2)))


def with_placeholders(upcoming: DataFrame) -> DataFrame:
    """Games to come in the canonical columns, with what only a played game has filled in: no winner, no scores."""
    there = set(upcoming.columns)
    given = {"gameDateOnlyStr": F.date_format("gameDate", "yyyy-MM-dd"), "season": season_of("gameDate")}
    constants = {"postponed": F.lit(0), "winner": F.lit(0).cast("long"), "homeScore": F.lit(0).cast("long"), "awayScore": F.lit(0).cast("long"), "gameType": F.lit("Regular Season")}
    unknown = {"overtimes": F.lit(None).cast("int"), "arenaId": F.lit(None).cast("long"), "attendance": F.lit(None).cast("long")}
    return upcoming.withColumns({k: v for k, v in given.items() if k not in there} | constants | unknown).drop("arenaCity", "arenaName")


def slate_features(history: DataFrame, slate: DataFrame, teams: DataFrame, groups: Mapping[str, Group], which: str, alpha: float = 1.0, beta: float = 0.1, pairs: Sequence[Momentum] = ()) -> DataFrame:
    """Features of the slate's games (both tables in the columns of the games view), seen from all games before them.

    Of games of the slate that have no result, none counts for another: they are joined to the history only for their
    own row's windows, which end before it.
    """
    wide = League(history.unionByName(slate, allowMissingColumns=True), teams, alpha, beta).wide()
    mine = filter_by_conference(wide.join(slate.select("game_id"), "game_id", "left_semi").drop("win", "pts_diff"), which)
    return conference_features(create_momentum(create_deltas(mine, groups), pairs), which)


def select_features(table: DataFrame, groups: Mapping[str, Group], which: str, mode: str = "inclusion", but: Sequence[str] = (), pairs: Sequence[Momentum] = ()) -> tuple[DataFrame, list[str]]:
    """(features, expected ones that the table lacks): the declared columns, or with ``exclusion`` all but those in ``but``."""
    if mode == "exclusion":
        return table.drop(*but), []
    wanted = resolve_features(groups, which, pairs)
    lacking = [c for c in wanted if c not in table.columns]
    if lacking:
        log.warning("expected features are not in the data: %s", lacking)
    return table.select(*[c for c in wanted if c in table.columns]), lacking


def align(table: DataFrame, names: Sequence[str] | None, allow_missing: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that a model was fitted on, in its order, after those to ``keep``; missing ones are null, or an error."""
    if names is None:
        return table
    missing = [c for c in names if c not in table.columns]
    if missing and not allow_missing:
        raise ValueError(f"missing features: {missing}")
    return table.select(*keep, *[F.col(c) if c not in missing else F.lit(None).cast("double").alias(c) for c in names])


def missing_values(table: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """How many rows lack each feature; only features that some row lacks."""
    row = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first().asDict() if names else {}
    return {c: n for c, n in row.items() if n}


def predict_slate(table_of: Mapping[str, DataFrame], model_of: Mapping[str, tuple[PipelineModel, Mapping[str, Sequence[str]]]], allow_missing: bool = True) -> DataFrame:
    """One union of (game_id, filter, y_proba, y_pred), by game: each filter's model over that filter's features."""
    out = None
    for which, (model, kinds) in model_of.items():
        names = [c for kind in ("numeric", "flag", "category") for c in kinds[kind]]
        aligned = align(table_of[which], names, allow_missing, keep=["game_id"])
        scored = models.predict(model, aligned, kinds).select("game_id", F.lit(which).alias("filter"), "y_proba", "y_pred")
        out = scored if out is None else out.unionByName(scored)
    return out.orderBy("game_id", "filter")
