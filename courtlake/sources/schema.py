"""Canonical game columns and the names under which feeds deliver them."""

from __future__ import annotations

#: Canonical column and its Spark type.
GAME_COLUMNS = {
    "gameId": "bigint",
    "gameDate": "timestamp",
    "hometeamPrename": "string",
    "hometeamName": "string",
    "hometeamId": "bigint",
    "awayteamPrename": "string",
    "awayteamName": "string",
    "awayteamId": "bigint",
    "homeScore": "bigint",
    "awayScore": "bigint",
    "winner": "bigint",
    "gameType": "string",
    "attendance": "bigint",
    "arenaId": "bigint",
    "gameLabel": "string",
    "gameSubLabel": "string",
    "seriesGameNumber": "bigint",
}

#: A game without one of these is not ingested.
REQUIRED = ("gameDate", "hometeamId", "awayteamId", "homeScore", "awayScore")

#: Other names of the canonical columns.
SYNONYMS = {
    "gameId": ("game_id", "id", "gameid"),
    "gameDate": ("game_date", "date", "gamedate", "game_datetime"),
    "hometeamPrename": ("home_city", "homecity", "home_team_city"),
    "hometeamName": ("home_name", "homename", "home_team_name"),
    "hometeamId": ("home_team_id", "hometeamid", "homeid", "home_teamid"),
    "awayteamPrename": ("away_city", "awaycity", "away_team_city"),
    "awayteamName": ("away_name", "awayname", "away_team_name"),
    "awayteamId": ("away_team_id", "awayteamid", "awayid", "away_teamid"),
    "homeScore": ("home_score", "homescore", "home_pts", "homepoints"),
    "awayScore": ("away_score", "awayscore", "away_pts", "awaypoints"),
    "winner": ("winner_id", "winnerid", "winning_team_id"),
    "gameType": ("game_type", "type", "gametype"),
    "attendance": ("att", "attendance_count"),
    "arenaId": ("arena_id", "arenaid", "venue_id"),
    "gameLabel": ("game_label", "label"),
    "gameSubLabel": ("game_sublabel", "sub_label", "sublabel"),
    "seriesGameNumber": ("series_game_number", "seriesgamenumber", "series_no"),
}

#: Columns of a result file, as (canonical, name in the file, type).
RESULT_COLUMNS = (
    ("gameId", "gameId", "bigint"),
    ("gameDate", "gameDate", "timestamp"),
    ("gameDateOnlyStr", "gameDateOnlyStr", "string"),
    ("season", "season", "string"),
    ("hometeamPrename", "homeTeamCity", "string"),
    ("hometeamName", "homeTeamName", "string"),
    ("hometeamId", "hometeamId", "bigint"),
    ("awayteamPrename", "awayTeamCity", "string"),
    ("awayteamName", "awayTeamName", "string"),
    ("awayteamId", "awayteamId", "bigint"),
    ("homeScore", "homeTeamFinalScore", "bigint"),
    ("awayScore", "awayTeamFinalScore", "bigint"),
    ("winner", "winner", "bigint"),
    ("overtimes", "overtimes", "bigint"),
    ("postponed", "postponed", "bigint"),
    ("attendance", "attendance", "bigint"),
)
