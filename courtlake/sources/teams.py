"""Teams, schedules and raw games: readers that check what they read, and the tables that follow from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtlake.operators.prediction import season_of
from courtlake.sources.games import coerce

#: Labels of games on neutral ground, and what is no game of the regular season.
NEUTRAL_LABELS = ("NBA Berlin Game", "NBA London Game", "NBA Mexico City Game", "NBA Paris Game", "NBA Paris Games", "Emirates NBA Cup", "NBA Las Vegas Summer League")
NOT_REGULAR = ("Preseason", "Playoffs", "Play-in Tournament")
CUP_FINAL, CUP_FINAL_SUBLABEL, SUBLABELS_FROM, LABELS_FROM = 62300001, "Championship", "2024/25", "2025/26"
#: Fixed value: a team that still plays is said to play until this year.
STILL_ACTIVE = 2100


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def one_of(column: str, values: Iterable[str]) -> Column:
    """Is the value one of these; null is none of them."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def parse_raw_games(raw: DataFrame) -> DataFrame:
    """Raw games with types, season, overtimes and the postponed flag; rows without a date are left out, ids have to be numbers.

    A game is postponed if a score that it has is not above zero; where one of the two is missing, an away score of one
    counts as none too.  Scores that are both missing are no postponement.
    """
    names = {"hometeamCity": "hometeamPrename", "awayteamCity": "awayteamPrename"}
    raw = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    kinds = {"gameId": "bigint", "hometeamId": "bigint", "awayteamId": "bigint", "winner": "bigint", "homeScore": "bigint", "awayScore": "bigint", "attendance": "double", "arenaId": "bigint", "seriesGameNumber": "double"}
    typed = raw.withColumns({c: coerce(F.col(c).cast("string"), k) for c, k in kinds.items() if c in raw.columns} | {"gameDate": F.col("gameDate").try_cast("timestamp")})
    dated = typed.filter("gameDate is not null")
    ids = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is no number")).cast("bigint")) for c in ("gameId", "hometeamId", "awayteamId")}
    least = F.when(F.col("homeScore").isNull() | F.col("awayScore").isNull(), 1).otherwise(0)
    postponed = F.coalesce(F.col("homeScore") <= 0, F.lit(False)) | F.coalesce(F.col("awayScore") <= least, F.lit(False))
    more = {"gameDateOnlyStr": F.date_format("gameDate", "yyyy-MM-dd"), "season": season_of("gameDate"), "postponed": postponed.cast("int")}
    return dated.withColumns(ids).withColumns(more | ({} if "overtimes" in raw.columns else {"overtimes": F.lit(0)}))


def regular_season(games: DataFrame) -> DataFrame:
    """Games of the regular season: no other type, from ``LABELS_FROM`` no other label, no cup final; unknown ones stay."""
    early = F.col("season") < SUBLABELS_FROM
    final = F.when(early, F.coalesce(F.col("gameId") == CUP_FINAL, F.lit(False))).otherwise(one_of("gameSubLabel", [CUP_FINAL_SUBLABEL]))
    labelled = (F.col("season") >= LABELS_FROM) & one_of("gameLabel", NOT_REGULAR)
    return games.filter(~one_of("gameType", NOT_REGULAR) & ~final & ~labelled)


def split_postponed(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(played, postponed)"""
    return games.filter("postponed = 0"), games.filter("postponed = 1")


def with_neutral_flag(games: DataFrame, label: str = "gameLabel", drop: bool = False) -> DataFrame:
    flagged = games.withColumn("is_neutral_court_game", one_of(label, NEUTRAL_LABELS))
    return flagged.drop(label) if drop else flagged


def expand_seasons(history: DataFrame, league: str, current: int) -> DataFrame:
    """(teamId, teamCity, teamName, teamAbbrev, season, Conference): a row per team and season from its founding to its end, or to ``current``.

    Of entries that overlap, the one founded first counts.
    """
    mine = history.filter((F.col("league") == league) & ~F.coalesce(F.col("teamCity") == "All-star", F.lit(False)))
    till = F.least(F.when(F.col("seasonActiveTill") == STILL_ACTIVE, current + 1).otherwise(F.col("seasonActiveTill")).cast("int"), F.lit(current + 1))
    years = mine.withColumn("till", till).filter(F.col("seasonFounded") < F.col("till")).withColumn("year", F.explode(F.sequence(F.col("seasonFounded").cast("int"), F.col("till") - 1)))
    first = F.row_number().over(Window.partitionBy("teamId", "year").orderBy("seasonFounded", "teamCity", "teamName"))
    season = F.concat(F.col("year").cast("string"), F.lit("/"), F.right((F.col("year") + 1).cast("string"), F.lit(2)))
    kept = years.withColumn("place", first).filter("place = 1")
    return kept.select("teamId", "teamCity", "teamName", F.trim("teamAbbrev").alias("teamAbbrev"), season.alias("season"), "Conference")


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    """The teams' seasons as written before; an error that says how to make them if they are not there."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no teams at {path}: write expand_seasons(...) there first")
    return spark.read.parquet(path)


def with_conferences(games: DataFrame, teams: DataFrame, winner: bool = True) -> DataFrame:
    """Games with the conference, of that season, of both teams and of the winner."""
    out = games
    for side, key in (("hometeam", "hometeamId"), ("awayteam", "awayteamId"), *([("winnerteam", "winner")] if winner else [])):
        named = teams.select(F.col("teamId").alias(key), "season", F.col("Conference").alias(f"{side}Conference"))
        out = out.join(named, [key, "season"], "left")
    return out.select(*games.columns, *[c for c in out.columns if c not in games.columns])


def with_locations(games: DataFrame, places: DataFrame) -> DataFrame:
    """Games with ``hometeamLocation``, ``awayteamLocation`` and ``gameLocation`` (city, state); all of them are filled anew if any row lacks one.

    ``LA`` is spelled out in team cities first.
    """
    sides = ("hometeam", "awayteam")
    spelled = games.withColumns({f"{s}Prename": F.when(F.col(f"{s}Prename") == "LA", "Los Angeles").otherwise(F.col(f"{s}Prename")) for s in sides if f"{s}Prename" in games.columns})
    names = [f"{s}Location" for s in sides]
    if set(names) <= set(games.columns):
        lacking = spelled.filter(F.col(names[0]).isNull() | F.col(names[1]).isNull()).limit(1).count()
        if not lacking:
            return spelled
    out = spelled.drop(*names, "gameLocation")
    for s in sides:
        place = places.select(F.col("teamId").alias(f"{s}Id"), F.concat("city", F.lit(", "), "state").alias(f"{s}Location")).dropDuplicates([f"{s}Id"])
        out = out.join(place, f"{s}Id", "left")
    return out.withColumn("gameLocation", F.col("hometeamLocation"))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """A league's schedule (CSV): UTC times become naive ones, preseason games and games without a team are left out."""
    raw = spark.read.option("header", True).csv(path)
    absent = {"gameId", "gameDateTimeEst", "homeTeamId", "awayTeamId", "gameLabel"} - set(raw.columns)
    if absent:
        raise ValueError(f"the schedule lacks {sorted(absent)}")
    raw = raw.withColumnsRenamed({"homeTeamId": "hometeamId", "awayTeamId": "awayteamId"})
    at = F.to_utc_timestamp(F.try_to_timestamp("gameDateTimeEst"), F.current_timezone())
    timed = raw.withColumns({"gameDateTimeEst": at, "gameDate": at.cast("date"), "gameId": F.col("gameId").try_cast("bigint")})
    teams = timed.withColumns({c: F.col(c).try_cast("bigint") for c in ("hometeamId", "awayteamId")})
    return teams.filter(~one_of("gameLabel", ["Preseason"]) & ~F.coalesce(F.col("hometeamId") == 0, F.lit(False)) & ~F.coalesce(F.col("awayteamId") == 0, F.lit(False)))


def read_played(spark: SparkSession, path: str) -> DataFrame:
    """Games played, as Parquet; an error if there are none or no date is a date."""
    games = spark.read.parquet(path).withColumn("gameDate", F.col("gameDate").try_cast("timestamp"))
    row = games.agg(F.count("*").alias("n"), F.count("gameDate").alias("dated")).first()
    if not row["n"]:
        raise ValueError(f"no games in {path}")
    if not row["dated"]:
        raise ValueError(f"no valid date in {path}")
    return games


def next_slate(schedule: DataFrame, played: DataFrame) -> DataFrame:
    """What the schedule still holds for the last day of play, or if that is done, the games of the next day that has any."""
    last = played.agg(F.max("gameDate").cast("date").alias("last"))
    left = schedule.join(F.broadcast(last), F.col("gameDate") >= F.col("last"))  # one row
    done = played.select("gameId", F.col("gameDate").cast("date").alias("last"))
    open_games = left.join(done, ["gameId", "last"], "left_anti").filter((F.col("gameDate") > F.col("last")) | F.col("gameDate").eqNullSafe(F.col("last")))
    day = open_games.agg(F.min("gameDate").alias("day"))
    return open_games.join(F.broadcast(day), F.col("gameDate") == F.col("day")).select(*schedule.columns)  # one row
