"""Queries whose rows come from a fitted model, a seeded hash or a column lookup; only the last has an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.catalog import ORACLES as PLAN_ORACLES
from courtlake.catalog import QUERIES as PLAN_QUERIES
from courtlake.catalog import league_of
from courtlake.operators import models, splits
from courtlake.operators.deltas import feature_groups, resolve_features
from courtlake.operators.experiment import Settings, prepare
from courtlake.plans.base import DISTANCE_LAGS, LAGS, LOCATION_LAGS
from courtlake.sources.games import normalise

#: The groups and lags that a model is trained on.
GROUPS = feature_groups(
    {
        "record": {"enabled": False}, "sos": {"enabled": False}, "streak": {"enabled": False}, "last_season_record": {"enabled": False},
        "norm_point_differential": {"lags": LAGS, "location_lags": LOCATION_LAGS}, "sos_adj_record": {"lags": LAGS, "location_lags": LOCATION_LAGS},
        "distance": {"lags": DISTANCE_LAGS}, "indifference_flag": {"delta": True, "enabled": True}, "home_and_road": {"delta": True},
    }
)
#: All games count, however few a team has played: the smallest tables have some ten games a team.
SETTINGS = Settings(GROUPS, min_season=None, min_games=0, min_games_test=0)
FEATURES = resolve_features(GROUPS, "all")
KINDS = {"numeric": FEATURES, "flag": [], "category": []}

#: Names that a feed might use, by column of the games view.
FEED_NAMES = {"game_id": "Game-ID", "game_date": "date", "home": "homeid", "away": "away_teamid", "home_score": "home_pts", "away_score": "awayScores", "label": "game label"}


def _labelled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Train, val and test of all games; the table that fits pass over many times is cut off from the pipeline behind it."""
    return prepare(league_of(spark, sf_dir).wide(), SETTINGS)[0]


def _predicted(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = _labelled(spark, sf_dir)
        model = models.train(parts["train"], KINDS, models.learner(kind))
        return models.predict(model, parts["test"], KINDS).select("game_id", "y", "y_proba", "y_pred")

    return run


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _labelled(spark, sf_dir)
    model = models.train(parts["train"], KINDS, models.learner("forest"))
    val, test = (models.predict(model, parts[p], KINDS) for p in ("val", "test"))
    return models.calibrate(val, test)[0].select("game_id", "y", "y_proba", "y_pred")


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = models.select_features(_labelled(spark, sf_dir)["train"], "game_id", FEATURES)
    return spark.createDataFrame(sorted(verdict.items()), "feature string, verdict string")


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(PLAN_QUERIES["games_view"](spark, sf_dir).select("game_id"), "game_id")


def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = PLAN_QUERIES["games_view"](spark, sf_dir)
    out = normalise(games.select([F.col(c).cast("string").alias(n) for c, n in FEED_NAMES.items()]))
    day = F.date_format("gameDate", "yyyy-MM-dd").alias("gameDate")
    return out.select("gameId", day, "hometeamId", "awayteamId", "homeScore", "awayScore", "winner", "gameLabel")


QUERIES = {
    "train_forest": _predicted("forest"),
    "train_boosted": _predicted("boosted"),
    "calibrated": calibrated,
    "selected_features": selected_features,
    "random_split": random_split,
    "column_mapping": column_mapping,
}
ORACLES = {
    "column_mapping": f"""SELECT game_id AS "gameId", game_date AS "gameDate", home AS "hometeamId", away AS "awayteamId", home_score AS "homeScore",
       away_score AS "awayScore", winner, label AS "gameLabel" FROM ({PLAN_ORACLES["games_view"]}) g""",
}
