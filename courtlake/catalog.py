"""Queries by name, with the same plan in the oracle's SQL.

A plan is one declarative statement; Catalyst prunes columns, picks the joins
and shares the sort of a window over all lags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtlake.functions.dialect import ORACLE, SPARK, Dialect
from courtlake.operators.deltas import LOCATED, STEMS, Group, conference_features, create_deltas, resolve_features
from courtlake.plans.base import DISTANCE_LAGS, GAMES, LAGS, LOCATION_LAGS, TEAMS
from courtlake.plans.features import FEATURES
from courtlake.plans.league import GDS_LAGS, League
from courtlake.plans.tables import TABLES
from courtlake.plans.wide_statement import delta_features, wide_features

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Plans with a date in their result.  Dates leave the catalogue as ISO text, so that engines print them alike.
DAY_PLANS = frozenset("season_spine east_west_record east_record_at_east west_record_at_west".split())
GAME_DATE_PLANS = frozenset(
    """
games_view team_games dedupe_keep_latest dedupe_incremental next_slate analysis_frame
schedule_parse record_rolling home_record_rolling away_record_rolling pts_diff_rolling home_pts_diff_rolling
away_pts_diff_rolling season_avg_total_points norm_pts_diff_rolling home_norm_pts_diff_rolling away_norm_pts_diff_rolling streak
cum_win_pct attendance_rolling rested_days days_home_road travel_distance strength_of_schedule
sos_adjusted_record sos_adjusted_home_record sos_adjusted_away_record game_difficulty gds_home gds_away standings playoff_flags
wide_features
""".split()
)


def register(spark: SparkSession, sf_dir: str, statement: str) -> None:
    """Temp views of the source tables that a statement names."""
    for name in SOURCES:
        if name in statement:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _iso(name: str, statement: str) -> str:
    column = "day" if name in DAY_PLANS else "game_date" if name in GAME_DATE_PLANS else None
    if column is None:
        return statement
    return f"SELECT * REPLACE (CAST({column} AS STRING) AS {column}) FROM ({statement}) q"


def _query(plan: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        statement = plan(SPARK)
        register(spark, sf_dir, statement)
        return _iso_dates(spark.sql(statement))

    run.__name__ = plan.__name__
    return run


#: Every group with every window, all as deltas.
ALL_GROUPS = {
    name: Group({"gds": GDS_LAGS, "distance": DISTANCE_LAGS}.get(name, LAGS) if STEMS[name] else (), LOCATION_LAGS if name in LOCATED and STEMS[name] else ()) for name in STEMS
} | {"home_and_road": Group(), "neutral_court": Group(delta=False)}


def deltas(wide: DataFrame) -> DataFrame:
    """All features of all games: every delta, days at home and on the road, neutral courts and the conferences' edge."""
    return conference_features(create_deltas(wide, ALL_GROUPS), "all").select("game_id", *resolve_features(ALL_GROUPS, "all"))


#: Families that the league's own pipeline computes; their statements, in another formulation, are the oracle.
LEAGUE: dict[str, Callable[[League], DataFrame]] = {
    "travel_distance": League.travel_distance,
    "days_home_road": League.days_home_road,
    "strength_of_schedule": League.schedule_strength,
    "sos_adjusted_record": League.sos_adjusted_record,
    "sos_adjusted_home_record": lambda league: league.sos_adjusted_record(1),
    "sos_adjusted_away_record": lambda league: league.sos_adjusted_record(0),
    "game_difficulty": League.game_difficulty,
    "gds_home": lambda league: league.game_difficulty(1),
    "gds_away": lambda league: league.game_difficulty(0),
    "adjusted_last_season_record": League.last_season_adjusted,
    "adjusted_last_season_home_record": lambda league: league.last_season_adjusted("_home"),
    "adjusted_last_season_away_record": lambda league: league.last_season_adjusted("_away"),
    "standings": League.standings,
    "playoff_flags": League.playoff_flags,
    "wide_features": League.wide,
    "delta_features": lambda league: deltas(league.wide()),
}


def league_of(spark: SparkSession, sf_dir: str, alpha: float = 1.0, beta: float = 0.1) -> League:
    """The league that the order tables stand for."""
    games, teams = f"WITH {GAMES} SELECT * FROM games", f"WITH {TEAMS} SELECT * FROM teams"
    register(spark, sf_dir, games + teams)
    return League(spark.sql(games), spark.sql(teams), alpha, beta)


def _iso_dates(frame: DataFrame) -> DataFrame:
    dates = [c for c, kind in frame.dtypes if kind == "date"]
    return frame.withColumns({c: frame[c].cast("string") for c in dates}) if dates else frame


def _league_query(family: Callable[[League], DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _iso_dates(family(league_of(spark, sf_dir)))

    run.__name__ = name
    return run


PLANS = {plan.__name__: plan for plan in [*TABLES, *FEATURES, wide_features, delta_features]}
QUERIES = {name: _query(plan) for name, plan in PLANS.items()} | {name: _league_query(family, name) for name, family in LEAGUE.items()}
ORACLES = {name: _iso(name, plan(ORACLE)) for name, plan in PLANS.items()}


#: The catalogue's games view, drawn from games in canonical columns instead of the order tables.
LEAGUE_GAMES = """
gm AS (SELECT *, CAST(CASE WHEN month(gameDate) >= 9 THEN year(gameDate) ELSE year(gameDate) - 1 END AS BIGINT) AS y FROM {games}),
games AS (SELECT gameId AS game_id, CAST(gameDate AS DATE) AS game_date, CAST(y AS STRING) || '/' || right(CAST(y + 1 AS STRING), 2) AS season, y AS season_start,
                 hometeamId AS home, awayteamId AS away, homeScore AS home_score, awayScore AS away_score, winner, gameLabel AS label, arenaId AS arena,
                 CASE WHEN homeScore > 0 AND awayScore > 0 THEN 0 ELSE 1 END AS postponed FROM gm)"""
LEAGUE_TEAMS = """
teams AS (SELECT CAST(teamId AS BIGINT) AS team, teamName AS name, Conference AS conf FROM {teams})"""


def run_plan(name: str, games: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """A plan over ingested games (canonical columns) and teams (teamId, teamName, Conference), not the order tables."""
    if name in LEAGUE:
        if teams is None:
            raise ValueError(f"{name} needs teams")
        spark = games.sparkSession
        view = spark.sql(f"WITH {LEAGUE_GAMES.replace('{games}', '{league_games}')} SELECT * FROM games", league_games=games)
        return LEAGUE[name](League(view, spark.sql(f"WITH {LEAGUE_TEAMS.replace('{teams}', '{league_teams}')} SELECT * FROM teams", league_teams=teams)))
    statement = PLANS[name](SPARK)
    if GAMES not in statement or (TEAMS in statement and teams is None):
        raise ValueError(f"{name} needs {'teams' if GAMES in statement else 'other tables'}")
    statement = statement.replace(GAMES, LEAGUE_GAMES).replace(TEAMS, LEAGUE_TEAMS)
    statement = statement.replace("{games}", "{league_games}").replace("{teams}", "{league_teams}")
    frames = {"league_games": games} | ({"league_teams": teams} if "{league_teams}" in statement else {})
    return games.sparkSession.sql(statement, **frames)
