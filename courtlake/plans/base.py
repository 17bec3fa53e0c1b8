"""The games view over the order tables, and the one unpivot into team rows.

Nations act as teams.  Each day the nations that ordered are ranked by their
first order and paired, so a team plays once a day at most and nobody ties.
"""

from __future__ import annotations

LAGS = (1, 3, 5, 8, 13, 21, 34, 55, 82)
LOCATION_LAGS = (5, 10, 20, 41)
DISTANCE_LAGS = (1, 3, 7, 14)

GAMES = """
td AS (SELECT CAST(o.o_orderdate AS DATE) AS d, c.c_nationkey AS team, MIN(o.o_orderkey) AS k,
              SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS cents
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY k) AS rn FROM td),
pr AS (SELECT h.d, CAST(h.team AS BIGINT) AS home, CAST(a.team AS BIGINT) AS away, h.k AS game_id,
              CAST(80 + h.cents % 60 AS BIGINT) AS hs, CAST(80 + a.cents % 60 AS BIGINT) AS aws
       FROM rk h JOIN rk a ON h.d = a.d AND h.rn % 2 = 1 AND a.rn = h.rn + 1),
gm AS (SELECT game_id, d AS game_date, CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END AS y, home, away,
              CASE WHEN hs = aws THEN hs + 1 ELSE hs END AS home_score, aws AS away_score FROM pr),
games AS (SELECT game_id, game_date, CAST(y AS STRING) || '/' || right(CAST(y + 1 AS STRING), 2) AS season, CAST(y AS BIGINT) AS season_start,
                 home, away, home_score, away_score, CASE WHEN home_score > away_score THEN home ELSE away END AS winner,
                 CASE WHEN game_id % 50 = 0 THEN 'Preseason' WHEN game_id % 50 = 1 THEN 'Neutral Cup' WHEN game_id % 50 < 10 THEN NULL ELSE 'Regular' END AS label,
                 home * 100 + CASE WHEN game_id % 10 < 7 THEN 0 WHEN game_id % 10 < 9 THEN 1 ELSE 2 END AS arena,
                 CASE WHEN game_id % 97 = 0 THEN 1 ELSE 0 END AS postponed
          FROM gm)"""

TEAM_GAMES = (
    GAMES
    + """,
tg AS (SELECT game_id, game_date, season, season_start, home AS team, away AS opp, 1 AS is_home, CASE WHEN winner = home THEN 1 ELSE 0 END AS win,
              home_score - away_score AS diff, home_score + away_score AS total FROM games
       UNION ALL
       SELECT game_id, game_date, season, season_start, away, home, 0, CASE WHEN winner <> home THEN 1 ELSE 0 END,
              away_score - home_score, home_score + away_score FROM games)"""
)

TEAMS = """
teams AS (SELECT CAST(n_nationkey AS BIGINT) AS team, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'East' ELSE 'West' END AS conf FROM nation)"""

#: Order of a team's games; every ordered operator shares it, so one sort serves all lags.
W = "PARTITION BY season, team ORDER BY game_date, game_id"


def previous(x: str, n: int | str, window: str = W) -> str:
    """Mean of x over the n games before this one (NULL for the first)."""
    frame = f"OVER ({window} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CAST(SUM({x}) {frame} AS DOUBLE) / NULLIF(COUNT({x}) {frame}, 0)"


def before(x: str, window: str = W) -> str:
    """Running sum of x over all games before this one."""
    return f"COALESCE(SUM({x}) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
