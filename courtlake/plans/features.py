"""Feature families as SQL plans; each takes a dialect and returns one statement."""

from __future__ import annotations

from courtlake.functions.dialect import Dialect
from courtlake.plans.base import DISTANCE_LAGS, GAMES, LAGS, LOCATION_LAGS, TEAM_GAMES, TEAMS, W, before, previous

KEY = "game_id, season, team, game_date"
#: The largest lag: a season's strength of schedule, and the adjusted record that stands for an opponent's quality.
SEASON = max(LAGS)
MEASURED = "measured AS (SELECT *, ROW_NUMBER() OVER (" + W + ") AS rn FROM tg)"


def _record(d: Dialect, side: str, lags: tuple[int, ...], win: str = "win") -> str:
    cols = ", ".join(f"{d.r(previous(win, n), 4)} AS record_L{n}" for n in lags)
    return f"""WITH {TEAM_GAMES}
SELECT {KEY}, CAST({before(win)} AS BIGINT) AS total_wins, CAST({before(f'1 - {win}')} AS BIGINT) AS total_losses,
       CAST(ROW_NUMBER() OVER ({W}) - 1 AS BIGINT) AS games_played, {cols}
FROM tg {side}"""


def record_rolling(d: Dialect) -> str:
    return _record(d, "", LAGS)


def home_record_rolling(d: Dialect) -> str:
    return _record(d, "WHERE is_home = 1", LOCATION_LAGS)


def away_record_rolling(d: Dialect) -> str:
    return _record(d, "WHERE is_home = 0", LOCATION_LAGS)


def _points(d: Dialect, side: str, lags: tuple[int, ...]) -> str:
    cols = ", ".join(f"COALESCE({d.r(previous('diff', n), 4)}, 0.0) AS pts_diff_avg_L{n}" for n in lags)
    return f"WITH {TEAM_GAMES} SELECT {KEY}, CAST(diff AS BIGINT) AS pts_diff, {cols} FROM tg {side}"


def pts_diff_rolling(d: Dialect) -> str:
    return _points(d, "", LAGS)


def home_pts_diff_rolling(d: Dialect) -> str:
    return _points(d, "WHERE is_home = 1", LOCATION_LAGS)


def away_pts_diff_rolling(d: Dialect) -> str:
    return _points(d, "WHERE is_home = 0", LOCATION_LAGS)


def _season_avg(d: Dialect) -> str:
    frame = "OVER (PARTITION BY season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    pts = "home_score + away_score"
    return f"""overall AS (SELECT CAST(SUM({pts}) AS DOUBLE) / COUNT(*) AS m FROM games),
league AS (SELECT game_id, season, game_date, COALESCE({d.r(f'CAST(SUM({pts}) {frame} AS DOUBLE) / NULLIF(COUNT(*) {frame}, 0)', 4)}, m) AS league_avg
           FROM games CROSS JOIN overall)"""


def season_avg_total_points(d: Dialect) -> str:
    return f"WITH {GAMES}, {_season_avg(d)} SELECT game_id, season, game_date, {d.r('league_avg', 4)} AS league_avg FROM league"


def _norm_points(d: Dialect, side: str, lags: tuple[int, ...]) -> str:
    # Scaled to whole billionths, so that sums are exact in any order.
    scaled = "CAST(ROUND(COALESCE(diff / NULLIF(league_avg, 0), 0.0) * 1e9) AS BIGINT)"
    cols = ", ".join(f"COALESCE({d.r(previous('norm', n) + ' / 1e9', 6)}, 0.0) AS norm_pts_diff_avg_L{n}" for n in lags)
    return f"""WITH {TEAM_GAMES}, {_season_avg(d)},
nm AS (SELECT tg.*, {scaled} AS norm FROM tg JOIN league l ON tg.game_id = l.game_id)
SELECT {KEY}, {cols} FROM nm {side}"""


def norm_pts_diff_rolling(d: Dialect) -> str:
    return _norm_points(d, "", LAGS)


def home_norm_pts_diff_rolling(d: Dialect) -> str:
    return _norm_points(d, "WHERE is_home = 1", LOCATION_LAGS)


def away_norm_pts_diff_rolling(d: Dialect) -> str:
    return _norm_points(d, "WHERE is_home = 0", LOCATION_LAGS)


def streak(d: Dialect) -> str:
    return f"""WITH {TEAM_GAMES},
a AS (SELECT {KEY}, LAG(win) OVER ({W}) AS last_win FROM tg),
b AS (SELECT *, CASE WHEN last_win = LAG(last_win) OVER ({W}) THEN 0 ELSE 1 END AS turn FROM a),
c AS (SELECT *, SUM(turn) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT {KEY}, CAST(CASE WHEN last_win IS NULL THEN 0 ELSE (2 * last_win - 1) * ROW_NUMBER() OVER (PARTITION BY season, team, run ORDER BY game_date, game_id) END AS BIGINT) AS streak
FROM c"""


def cum_win_pct(d: Dialect) -> str:
    return f"""WITH {TEAM_GAMES} SELECT {KEY}, {d.r(f'CAST({before("win")} AS DOUBLE) / NULLIF(ROW_NUMBER() OVER ({W}) - 1, 0)', 6)} AS prior_win_pct FROM tg"""


def centered_home_win_ratio(d: Dialect) -> str:
    frame = "OVER (ORDER BY season_start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"""WITH {GAMES},
s AS (SELECT season, season_start, CAST(SUM(CASE WHEN winner = home THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS ratio FROM games GROUP BY season, season_start)
SELECT season, {d.r('ratio', 6)} AS home_win_ratio,
       CASE WHEN COUNT(*) {frame} = 5 THEN {d.r(f'SUM(CAST(ROUND(ratio * 1e9) AS BIGINT)) {frame} / 5.0e9', 6)} END AS rolling_ratio FROM s"""


def attendance_rolling(d: Dialect) -> str:
    w = "PARTITION BY arena ORDER BY game_date, game_id"
    return f"""WITH {GAMES},
a AS (SELECT game_id, arena, game_date, 10000 + game_id % 9000 AS attendance FROM games),
b AS (SELECT *, {previous('attendance', 5, w)} AS m FROM a)
SELECT game_id, arena, game_date, LAG(attendance) OVER ({w}) AS last_attendance,
       {d.r(f"COALESCE(m, {d.first('m')} OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 4)} AS occupation FROM b"""


def season_spine(d: Dialect) -> str:
    return f"""WITH {GAMES}, s AS (SELECT season, MIN(game_date) AS lo, MAX(game_date) AS hi FROM games GROUP BY season)
SELECT season, {d.spine('lo', 'hi')} AS day FROM s"""


def _cross(d: Dialect, only: str) -> str:
    """Cross-conference results per day before today, on the season's calendar."""
    return f"""WITH {GAMES}, {TEAMS},
s AS (SELECT season, MIN(game_date) AS lo, MAX(game_date) AS hi FROM games GROUP BY season),
days AS (SELECT season, {d.spine('lo', 'hi')} AS day FROM s),
x AS (SELECT g.season, g.game_date AS day, h.conf AS home_conf, CASE WHEN (g.winner = g.home) = (h.conf = 'East') THEN 1 ELSE 0 END AS east_win
      FROM games g JOIN teams h ON g.home = h.team JOIN teams a ON g.away = a.team WHERE h.conf <> a.conf),
byday AS (SELECT season, day, SUM(CASE WHEN home_conf = 'East' THEN east_win ELSE 0 END) AS ee, SUM(CASE WHEN home_conf = 'East' THEN 1 ELSE 0 END) AS eg,
                 SUM(CASE WHEN home_conf = 'West' THEN east_win ELSE 0 END) AS we, SUM(CASE WHEN home_conf = 'West' THEN 1 ELSE 0 END) AS wg FROM x GROUP BY season, day),
cum AS (SELECT days.season, days.day, {", ".join(f"COALESCE(SUM({c}) OVER (PARTITION BY days.season ORDER BY days.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {c}" for c in ("ee", "eg", "we", "wg"))}
        FROM days LEFT JOIN byday ON days.season = byday.season AND days.day = byday.day),
pct AS (SELECT *, CAST(ee AS DOUBLE) / NULLIF(eg, 0) AS at_east, CAST(we AS DOUBLE) / NULLIF(wg, 0) AS at_west,
               CAST(eg - ee AS DOUBLE) / NULLIF(eg, 0) AS west_at_east, CAST(wg - we AS DOUBLE) / NULLIF(wg, 0) AS west_at_west FROM cum)
{only}"""


EAST = "COALESCE((at_east + at_west) / 2, at_east, at_west, 0.0)"
WEST = "COALESCE((west_at_east + west_at_west) / 2, west_at_east, west_at_west, 0.0)"


def east_west_record(d: Dialect) -> str:
    return _cross(d, f"SELECT season, day, {d.r(EAST, 4)} AS east_adjusted_record, {d.r(WEST, 4)} AS west_adjusted_record, CAST(eg + wg AS BIGINT) AS games_played_east_vs_west FROM pct")


def east_record_at_east(d: Dialect) -> str:
    return _cross(d, f"SELECT season, day, {d.r('COALESCE(at_east, 0.0)', 4)} AS east_at_east, CAST(eg AS BIGINT) AS games_played FROM pct")


def west_record_at_west(d: Dialect) -> str:
    return _cross(d, f"SELECT season, day, {d.r('COALESCE(west_at_west, 0.0)', 4)} AS west_at_west, CAST(wg AS BIGINT) AS games_played FROM pct")


def rested_days(d: Dialect) -> str:
    return f"""WITH {TEAM_GAMES},
s AS (SELECT season, MIN(game_date) AS lo FROM games GROUP BY season),
p AS (SELECT tg.game_id, tg.season, tg.team, tg.game_date, lo, LAG(tg.game_date) OVER (PARTITION BY tg.season, tg.team ORDER BY tg.game_date, tg.game_id) AS prev FROM tg JOIN s ON tg.season = s.season)
SELECT {KEY}, CAST(CASE WHEN prev IS NULL THEN {d.days('lo', 'game_date')} ELSE {d.days('prev', 'game_date')} - 1 END AS BIGINT) AS rested_days FROM p"""


def _located(d: Dialect) -> str:
    return f"""s AS (SELECT season, MIN(game_date) AS lo, MAX(game_date) AS hi FROM games GROUP BY season),
days AS (SELECT season, {d.spine('lo', 'hi')} AS day FROM s),
members AS (SELECT DISTINCT season, home AS team FROM games),
cal AS (SELECT m.season, m.team, days.day, tg.game_id, tg.is_home, tg.opp FROM members m JOIN days ON m.season = days.season
        LEFT JOIN tg ON tg.season = m.season AND tg.team = m.team AND tg.game_date = days.day)"""


def days_home_road(d: Dialect) -> str:
    w = "PARTITION BY season, team ORDER BY day"
    return f"""WITH {TEAM_GAMES}, {_located(d)},
loc AS (SELECT *, COALESCE({d.last('is_home')} OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS at_home FROM cal),
turn AS (SELECT *, CASE WHEN at_home = LAG(at_home) OVER ({w}) THEN 0 ELSE 1 END AS t FROM loc),
run AS (SELECT *, SUM(t) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM turn),
len AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season, team, r ORDER BY day) AS n FROM run)
SELECT game_id, season, team, day AS game_date, CAST(CASE WHEN at_home = 0 THEN 0 WHEN n > 30 THEN 1 ELSE n END AS BIGINT) AS days_at_home,
       CAST(CASE WHEN at_home = 1 THEN 0 WHEN n > 30 THEN 1 ELSE n END AS BIGINT) AS days_on_road FROM len WHERE game_id IS NOT NULL"""


def travel_distance(d: Dialect) -> str:
    w = "PARTITION BY season, team ORDER BY day"
    cols = ", ".join(f"{d.r(f'CAST(SUM(miles) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / COUNT(*) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)', 0)} AS distance_L{n}" for n in DISTANCE_LAGS)
    return f"""WITH {TEAM_GAMES}, {_located(d)},
place AS (SELECT *, CASE WHEN game_id IS NULL THEN NULL WHEN is_home = 1 THEN team ELSE opp END AS city FROM cal),
filled AS (SELECT *, COALESCE({d.last('city')} OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), team) AS known,
                  {d.first('city')} OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS coming FROM place),
early AS (SELECT *, CASE WHEN game_id IS NULL AND coming = team THEN team ELSE known END AS here FROM filled),
legs AS (SELECT *, LAG(here) OVER ({w}) AS there FROM early),
leg AS (SELECT *, CASE WHEN there IS NULL OR there = here THEN 0 ELSE (greatest(here, there) - least(here, there)) * 137 % 2500 + 50 END AS miles FROM legs WHERE game_id IS NOT NULL)
SELECT game_id, season, team, day AS game_date, CAST(miles AS BIGINT) AS miles, {cols} FROM leg"""


def _sos_cte(d: Dialect, lags: tuple[int, ...], least: int) -> str:
    most = max(lags)
    cols = ", ".join(
        f"CASE WHEN COUNT(CASE WHEN back <= {n} THEN pct END) >= {least} THEN {d.r(f'CAST(SUM(CASE WHEN back <= {n} THEN pct END) AS DOUBLE) / COUNT(CASE WHEN back <= {n} THEN pct END) / 1e9', 4)} END AS sos_L{n}"
        for n in lags
    )
    return f"""st AS (SELECT season, team, opp, game_id, game_date, win, ROW_NUMBER() OVER ({W}) AS rn,
        CAST(ROUND(CAST(SUM(win) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / ROW_NUMBER() OVER ({W}) * 1e9) AS BIGINT) AS pct,
        LEAD(game_date) OVER ({W}) AS nxt FROM tg),
met AS (SELECT i.season, i.team, i.game_id, i.game_date, j.opp, i.rn - j.rn AS back FROM st i LEFT JOIN st j
        ON i.season = j.season AND i.team = j.team AND j.rn BETWEEN i.rn - {most} AND i.rn - 1),
played AS (SELECT DISTINCT season, game_date FROM st),
squad AS (SELECT DISTINCT season, team FROM st),
closed AS (SELECT season, team, game_date, pct FROM st WHERE nxt IS NULL OR nxt > game_date),
form AS (SELECT q.season, q.team, p.game_date, {d.last('c.pct')} OVER (PARTITION BY q.season, q.team ORDER BY p.game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pct
         FROM squad q JOIN played p ON q.season = p.season LEFT JOIN closed c ON c.season = q.season AND c.team = q.team AND c.game_date = p.game_date),
looked AS (SELECT m.season, m.team, m.game_id, m.game_date, m.back, o.pct FROM met m LEFT JOIN form o
         ON o.season = m.season AND o.team = m.opp AND o.game_date = m.game_date),
sos AS (SELECT game_id, season, team, game_date, {cols} FROM looked GROUP BY game_id, season, team, game_date)"""


def strength_of_schedule(d: Dialect) -> str:
    return f"WITH {TEAM_GAMES}, {_sos_cte(d, LAGS, 3)} SELECT * FROM sos"


def _sos_adj(d: Dialect, lags: tuple[int, ...], side: str = "") -> str:
    rec = ", ".join(f"{d.r(previous('win', n), 4)} AS record_L{n}" for n in lags)
    day = "OVER (PARTITION BY r.season, r.game_date)"
    mean = "CAST(SUM(CAST(ROUND(sos_L{n} * 1e4) AS BIGINT)) {day} AS DOUBLE) / NULLIF(COUNT(sos_L{n}) {day}, 0) / 1e4"
    cols = ", ".join(f"{d.r(f'r.record_L{n} * (s.sos_L{n} / NULLIF({mean.format(n=n, day=day)}, 0))', 4)} AS sos_adj_record_L{n}" for n in lags)
    return f"""{_sos_cte(d, lags, 1)},
rec AS (SELECT {KEY}, opp, is_home, win, {rec} FROM tg {side}),
adj AS (SELECT r.game_id, r.season, r.team, r.game_date, r.opp, r.is_home, r.win, {cols}
        FROM rec r JOIN sos s ON r.game_id = s.game_id AND r.team = s.team AND r.season = s.season AND r.game_date = s.game_date)"""


def _sos_adjusted(d: Dialect, side: str, lags: tuple[int, ...]) -> str:
    return f"WITH {TEAM_GAMES}, {_sos_adj(d, lags, side)} SELECT {KEY}, {', '.join(f'sos_adj_record_L{n}' for n in lags)} FROM adj"


def sos_adjusted_record(d: Dialect) -> str:
    return _sos_adjusted(d, "", LAGS)


def sos_adjusted_home_record(d: Dialect) -> str:
    return _sos_adjusted(d, "WHERE is_home = 1", LOCATION_LAGS)


def sos_adjusted_away_record(d: Dialect) -> str:
    return _sos_adjusted(d, "WHERE is_home = 0", LOCATION_LAGS)


def _gds(d: Dialect, side: str, lags: tuple[int, ...]) -> str:
    w = W
    raw = d.r("CASE WHEN win = 1 THEN q * (1 + 0.1 * (1 - is_home)) ELSE -(1 - q) * (1 + 0.1 * is_home) END", 4)
    cols = ", ".join(f"{d.r(previous('units', n, w) + ' / 1e4', 4)} AS gds_L{n}" for n in lags)
    return f"""WITH {TEAM_GAMES}, {_sos_adj(d, (SEASON,))},
prior AS (SELECT game_id, team, CAST({before('win')} AS DOUBLE) / NULLIF(ROW_NUMBER() OVER ({W}) - 1, 0) AS pct FROM tg),
qq AS (SELECT a.*, COALESCE(o.sos_adj_record_L{SEASON}, p.pct) AS q0 FROM adj a
       LEFT JOIN adj o ON o.game_id = a.game_id AND o.team = a.opp LEFT JOIN prior p ON p.game_id = a.game_id AND p.team = a.opp),
q AS (SELECT *, CASE WHEN q0 IS NOT NULL THEN least(greatest(q0, 0.0), 1.0) END AS q FROM qq),
g AS (SELECT *, CAST(ROUND({raw} * 1e4) AS BIGINT) AS units FROM q {side})
SELECT {KEY}, {d.r('units / 1e4', 4)} AS gds, {cols} FROM g"""


def game_difficulty(d: Dialect) -> str:
    return _gds(d, "", LAGS[1:])


def gds_home(d: Dialect) -> str:
    return _gds(d, "WHERE is_home = 1", LOCATION_LAGS)


def gds_away(d: Dialect) -> str:
    return _gds(d, "WHERE is_home = 0", LOCATION_LAGS)


def _last_season(d: Dialect, side: str, name: str) -> str:
    return f"""WITH {TEAM_GAMES},
pct AS (SELECT season_start, team, {d.r('CAST(SUM(win) AS DOUBLE) / COUNT(*)', 4)} AS pct FROM tg {side} GROUP BY season_start, team),
low AS (SELECT season_start, MIN(pct) AS low FROM pct GROUP BY season_start),
now AS (SELECT DISTINCT season, season_start, team FROM tg)
SELECT now.season, now.team, COALESCE(pct.pct, low.low) AS {name} FROM now
LEFT JOIN pct ON pct.team = now.team AND pct.season_start = now.season_start - 1 LEFT JOIN low ON low.season_start = now.season_start - 1"""


def last_season_record(d: Dialect) -> str:
    return _last_season(d, "", "last_season_record")


def last_season_home_record(d: Dialect) -> str:
    return _last_season(d, "WHERE is_home = 1", "last_season_home_record")


def last_season_away_record(d: Dialect) -> str:
    return _last_season(d, "WHERE is_home = 0", "last_season_away_record")


def _adjusted_last_season(d: Dialect, side: str, name: str) -> str:
    return f"""WITH {TEAM_GAMES}, {_sos_cte(d, (SEASON,), 1)},
ranked AS (SELECT s.season, s.team, s.sos_L{SEASON}, ROW_NUMBER() OVER (PARTITION BY s.season, s.team ORDER BY s.game_date DESC, s.game_id DESC) AS k FROM sos s WHERE s.sos_L{SEASON} IS NOT NULL),
final AS (SELECT season, team, sos_L{SEASON} AS sos FROM ranked WHERE k = 1),
pct AS (SELECT season, season_start, team, {d.r('CAST(SUM(win) AS DOUBLE) / COUNT(*)', 4)} AS p FROM tg {side} GROUP BY season, season_start, team),
rated AS (SELECT pct.season_start, pct.team, pct.p, final.sos, CAST(SUM(CAST(ROUND(final.sos * 1e4) AS BIGINT)) OVER (PARTITION BY pct.season) AS DOUBLE) / NULLIF(COUNT(final.sos) OVER (PARTITION BY pct.season), 0) / 1e4 AS m
          FROM pct LEFT JOIN final ON final.season = pct.season AND final.team = pct.team),
adj AS (SELECT season_start, team, {d.r('p * (sos / NULLIF(m, 0))', 4)} AS pct FROM rated),
now AS (SELECT DISTINCT season, season_start, team FROM tg {side})
SELECT now.season, now.team, COALESCE(adj.pct, MIN(adj.pct) OVER (PARTITION BY now.season)) AS {name} FROM now
LEFT JOIN adj ON adj.team = now.team AND adj.season_start = now.season_start - 1"""


def adjusted_last_season_record(d: Dialect) -> str:
    return _adjusted_last_season(d, "", "adjusted_last_season_record")


def adjusted_last_season_home_record(d: Dialect) -> str:
    return _adjusted_last_season(d, "WHERE is_home = 1", "adjusted_last_season_home_record")


def adjusted_last_season_away_record(d: Dialect) -> str:
    return _adjusted_last_season(d, "WHERE is_home = 0", "adjusted_last_season_away_record")


def _standings(d: Dialect) -> str:
    return f"""{TEAM_GAMES}, {TEAMS},
ct AS (SELECT tg.*, t.conf, o.conf AS opp_conf FROM tg JOIN teams t ON tg.team = t.team JOIN teams o ON tg.opp = o.team),
cum AS (SELECT season, team, conf, game_date, LEAD(game_date) OVER ({W}) AS nxt,
               SUM(win) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wins, ROW_NUMBER() OVER ({W}) AS played,
               SUM(CASE WHEN conf = opp_conf THEN win ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
               SUM(CASE WHEN conf = opp_conf THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cg,
               SUM(diff) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd FROM ct),
len AS (SELECT season, CAST(floor(2.0 * COUNT(DISTINCT game_id) / COUNT(DISTINCT team)) AS BIGINT) AS length FROM tg GROUP BY season),
dates AS (SELECT DISTINCT season, conf, game_date FROM ct),
members AS (SELECT DISTINCT season, conf, team FROM ct),
snap AS (SELECT dt.season, dt.conf, dt.game_date, m.team, COALESCE(c.wins, 0) AS wins, COALESCE(c.played, 0) - COALESCE(c.wins, 0) AS losses,
                COALESCE(CAST(c.cw AS DOUBLE) / NULLIF(c.cg, 0), 0.0) AS cpct, COALESCE(c.pd, 0) AS pd, greatest(l.length - COALESCE(c.played, 0), 0) AS remaining
         FROM dates dt JOIN members m ON m.season = dt.season AND m.conf = dt.conf JOIN len l ON l.season = dt.season
         LEFT JOIN cum c ON c.season = dt.season AND c.team = m.team AND c.game_date < dt.game_date AND (c.nxt IS NULL OR c.nxt >= dt.game_date)),
hh AS (SELECT season, team, opp, game_date, LEAD(game_date) OVER (PARTITION BY season, team, opp ORDER BY game_date, game_id) AS nxt,
              SUM(win) OVER (PARTITION BY season, team, opp ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM ct WHERE conf = opp_conf),
tied AS (SELECT a.season, a.conf, a.game_date, a.team, SUM(hh.w) AS h2h FROM snap a
         JOIN snap b ON a.season = b.season AND a.conf = b.conf AND a.game_date = b.game_date AND a.wins = b.wins AND a.losses = b.losses AND a.team <> b.team
         JOIN hh ON hh.season = a.season AND hh.team = a.team AND hh.opp = b.team AND hh.game_date < a.game_date AND (hh.nxt IS NULL OR hh.nxt >= a.game_date)
         GROUP BY a.season, a.conf, a.game_date, a.team),
ranked AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.season, s.conf, s.game_date ORDER BY s.wins DESC, s.losses, COALESCE(t.h2h, 0) DESC, s.cpct DESC, s.pd DESC, s.team) AS conf_rank,
                  COUNT(*) OVER (PARTITION BY s.season, s.conf, s.game_date) AS n FROM snap s LEFT JOIN tied t ON t.season = s.season AND t.conf = s.conf AND t.game_date = s.game_date AND t.team = s.team)"""


def standings(d: Dialect) -> str:
    o = "PARTITION BY season, conf, game_date ORDER BY conf_rank"
    behind = "(({a} - wins) + (losses - {b})) / 2.0"
    lead = behind.format(a=f"FIRST_VALUE(wins) OVER ({o})", b=f"FIRST_VALUE(losses) OVER ({o})")
    above = behind.format(a=f"LAG(wins) OVER ({o})", b=f"LAG(losses) OVER ({o})")
    below = f"((wins - LEAD(wins) OVER ({o})) + (LEAD(losses) OVER ({o}) - losses)) / 2.0"
    return f"""WITH {_standings(d)},
gb AS (SELECT season, conf, game_date, team, wins, losses, conf_rank, {lead} AS behind_leader, {above} AS behind_above, {below} AS lead_below FROM ranked)
SELECT tg.game_id, gb.season, gb.team, gb.game_date, gb.conf, CAST(gb.wins AS BIGINT) AS wins, CAST(gb.losses AS BIGINT) AS losses, CAST(conf_rank AS BIGINT) AS conf_rank,
       CAST(behind_leader AS DOUBLE) AS behind_leader, CAST(behind_above AS DOUBLE) AS behind_above, CAST(lead_below AS DOUBLE) AS lead_below
FROM gb JOIN tg ON tg.season = gb.season AND tg.team = gb.team AND tg.game_date = gb.game_date"""


def playoff_flags(d: Dialect) -> str:
    return f"""WITH {_standings(d)},
pair AS (SELECT a.season, a.conf, a.game_date, a.team, a.n, CASE WHEN CAST(left(a.season, 4) AS BIGINT) < 2020 THEN 8 ELSE 10 END AS cutoff,
         COUNT(CASE WHEN b.team <> a.team AND b.wins + b.remaining >= a.wins THEN 1 END) AS can_catch,
         COUNT(CASE WHEN b.team <> a.team AND b.wins > a.wins + a.remaining THEN 1 END) AS out_of_reach,
         COUNT(CASE WHEN b.conf_rank > a.conf_rank AND b.wins + b.remaining >= a.wins THEN 1 END) AS below_threat,
         COUNT(CASE WHEN b.conf_rank < a.conf_rank AND b.wins <= a.wins + a.remaining THEN 1 END) AS above_reach
  FROM ranked a JOIN ranked b ON a.season = b.season AND a.conf = b.conf AND a.game_date = b.game_date GROUP BY a.season, a.conf, a.game_date, a.team, a.n),
flag AS (SELECT *, CASE WHEN can_catch < least(cutoff, n) THEN 1 ELSE 0 END AS clinched, CASE WHEN out_of_reach >= least(cutoff, n) THEN 1 ELSE 0 END AS eliminated,
                CASE WHEN below_threat = 0 AND above_reach = 0 THEN 1 ELSE 0 END AS seed_locked FROM pair)
SELECT tg.game_id, f.season, f.team, f.game_date, CAST(clinched AS BIGINT) AS clinched, CAST(eliminated AS BIGINT) AS eliminated, CAST(seed_locked AS BIGINT) AS seed_locked,
       CAST(greatest(eliminated, seed_locked) AS BIGINT) AS indifference_flag
FROM flag f JOIN tg ON tg.season = f.season AND tg.team = f.team AND tg.game_date = f.game_date"""


def h2h_records(d: Dialect) -> str:
    w = "PARTITION BY season, team, opp ORDER BY game_date, game_id"
    return f"""WITH {TEAM_GAMES}, {TEAMS}
SELECT tg.game_id, season, tg.team, tg.opp, CAST(SUM(win) OVER ({w.replace('team,', 'tg.team,')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS h2h_wins
FROM tg JOIN teams a ON tg.team = a.team JOIN teams b ON tg.opp = b.team WHERE a.conf = b.conf"""


def games_remaining(d: Dialect) -> str:
    return f"""WITH {TEAM_GAMES}, len AS (SELECT season, CAST(floor(2.0 * COUNT(DISTINCT game_id) / COUNT(DISTINCT team)) AS BIGINT) AS length FROM tg GROUP BY season)
SELECT game_id, tg.season, team, CAST(ROW_NUMBER() OVER (PARTITION BY tg.season, team ORDER BY game_date, game_id) AS BIGINT) AS games_played,
       CAST(greatest(length - ROW_NUMBER() OVER (PARTITION BY tg.season, team ORDER BY game_date, game_id), 0) AS BIGINT) AS games_remaining FROM tg JOIN len ON tg.season = len.season"""


def _wide_cte(d: Dialect) -> str:
    rec = ", ".join(f"{d.r(previous('win', n), 4)} AS record_L{n}, COALESCE({d.r(previous('diff', n), 4)}, 0.0) AS pts_diff_avg_L{n}" for n in (5, 13, 34))
    return f"""{TEAM_GAMES}, {TEAMS},
side AS (SELECT game_id, team, is_home, CAST(ROW_NUMBER() OVER ({W}) - 1 AS BIGINT) AS games_played, LAG(win) OVER ({W}) AS last_win,
                COALESCE({d.days(f'LAG(game_date) OVER ({W})', 'game_date')} - 1, 0) AS rested, {rec} FROM tg),
wide AS (SELECT g.game_id, g.season, g.game_date, g.home, g.away, th.conf AS home_conf, ta.conf AS away_conf, CASE WHEN g.winner = g.home THEN 1 ELSE 0 END AS win,
  {", ".join(f"{a}.{c} AS {c}_{s}" for a, s in (("h", "HT"), ("v", "VT")) for c in ("games_played", "last_win", "rested", *(f"{x}_L{n}" for n in (5, 13, 34) for x in ("record", "pts_diff_avg"))))}
  FROM games g JOIN side h ON h.game_id = g.game_id AND h.is_home = 1 JOIN side v ON v.game_id = g.game_id AND v.is_home = 0
  JOIN teams th ON th.team = g.home JOIN teams ta ON ta.team = g.away)"""


def momentum(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id, {d.r('(record_L5_HT - record_L5_VT) - (record_L34_HT - record_L34_VT)', 4)} AS record_momentum FROM wide"


def filter_same_conference(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id FROM wide WHERE home_conf = away_conf"


def filter_different_conference(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id FROM wide WHERE NOT (home_conf = away_conf) OR home_conf IS NULL OR away_conf IS NULL"


def filter_minimum_games(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id FROM wide WHERE games_played_HT > 15 AND games_played_VT > 15"


def _ew(d: Dialect, select: str) -> str:
    return _cross(d, "").rstrip() + f""",
ew AS (SELECT g.game_id, th.conf AS hc, ta.conf AS ac, {d.r(EAST, 4)} AS east, {d.r(WEST, 4)} AS west,
              {d.r('COALESCE(at_east, 0.0)', 4)} AS ee_pct, {d.r('COALESCE(west_at_west, 0.0)', 4)} AS ww_pct, eg, wg
       FROM games g JOIN pct ON pct.season = g.season AND pct.day = g.game_date JOIN teams th ON th.team = g.home JOIN teams ta ON ta.team = g.away)
{select}"""


def conference_delta(d: Dialect) -> str:
    sign = "(CASE WHEN hc = 'East' THEN 1 ELSE 0 END - CASE WHEN ac = 'East' THEN 1 ELSE 0 END)"
    return _ew(d, f"SELECT game_id, {d.r(f'{sign} * (east - west)', 4)} AS conference_delta FROM ew")


def conference_vs_conference(d: Dialect) -> str:
    return _ew(d, "SELECT game_id, CASE WHEN hc = 'East' THEN ee_pct ELSE ww_pct END AS home_conf_record, CAST(CASE WHEN hc = 'East' THEN eg ELSE wg END AS BIGINT) AS home_conf_games FROM ew")


def sample_weights(d: Dialect) -> str:
    """Spark ranks the seasons, not the games."""
    ranks = "o AS (SELECT w.*, s.k, s.top FROM wide w JOIN s ON s.season = w.season)" if d.spark else "m AS (SELECT *, DENSE_RANK() OVER (ORDER BY season) AS k FROM wide), t AS (SELECT MAX(k) AS top FROM m), o AS (SELECT * FROM m CROSS JOIN t)"
    seasons = "s AS (SELECT season, ROW_NUMBER() OVER (ORDER BY season) AS k, COUNT(*) OVER () AS top FROM (SELECT DISTINCT season FROM wide) q), " if d.spark else ""
    return f"""WITH {_wide_cte(d)}, {seasons}{ranks}
SELECT game_id, {d.r('least(greatest(least(games_played_HT, games_played_VT) / 3.0e1, 0.0e0), 1.0e0) * exp(-1.0e-1 * (top - k))', 6)} AS weight FROM o"""


FEATURES = [
    record_rolling, home_record_rolling, away_record_rolling, pts_diff_rolling, home_pts_diff_rolling, away_pts_diff_rolling, season_avg_total_points,
    norm_pts_diff_rolling, home_norm_pts_diff_rolling, away_norm_pts_diff_rolling, streak, cum_win_pct, centered_home_win_ratio, attendance_rolling, season_spine,
    east_west_record, east_record_at_east, west_record_at_west, rested_days, days_home_road, travel_distance, strength_of_schedule, sos_adjusted_record,
    sos_adjusted_home_record, sos_adjusted_away_record,
    game_difficulty, gds_home, gds_away, last_season_record, last_season_home_record, last_season_away_record, adjusted_last_season_record,
    adjusted_last_season_home_record, adjusted_last_season_away_record, standings,
    playoff_flags, h2h_records, games_remaining, momentum, filter_same_conference, filter_different_conference,
    filter_minimum_games, conference_delta, conference_vs_conference, sample_weights,
]
