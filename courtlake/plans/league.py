"""The feature families of a league as one pipeline of DataFrames.

``League`` unpivots the games once and derives every family from that table:

* Windows over (season, team) share one exchange, and those over one side of it
  (home or away games) too, since that is a finer key.
* Calendars are never spelled out: runs of days at one place, rest and trips
  follow from a game and the one before it, in closed form.
* As-of values are carried forward along (team, day of play) by one sort, not
  found by range joins; a team's last opponents are an array of the shared
  window, looked up by an equi-join.
* Totals of a season go over days, which a season has few of, not over games.
* Conference snapshots compare a team with its conference inside one row, by
  the array of the conference on that day.
* The wide table pairs the two rows of a game by one window over the game, so
  every family crosses the network once, not once per side.

The catalogue's statements say the same family by family in plain SQL; they are
the oracle of this module.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from courtlake.functions.dialect import SPARK
from courtlake.functions.scratch import cut
from courtlake.plans.base import DISTANCE_LAGS, LAGS, LOCATION_LAGS, W, before, previous

r = SPARK.r
SIDE = "PARTITION BY season, team, is_home ORDER BY game_date, game_id"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
KEY = ("game_id", "season", "team", "game_date")
#: The largest lag: a season's strength of schedule, and the adjusted record that stands for an opponent's quality.
SEASON = max(LAGS)
#: Teams' forms by day of play are broadcast up to so many rows (some 30 bytes each); above, the join shuffles.
BROADCAST_FORMS = 1_000_000
GDS_LAGS = LAGS[1:]
FLAGS = ("conf_rank", "games_behind_leader", "games_behind_above", "games_ahead_of_below", "clinched_playoff_berth", "eliminated_from_playoffs", "clinched_final_seed", "indifference_flag")
LAST_SEASON = ("last_season_record", "last_season_home_record", "last_season_away_record", "adjusted_last_season_record", "adjusted_last_season_home_record", "adjusted_last_season_away_record")


def _lags(stem: str, lags: tuple[int, ...]) -> list[str]:
    return [f"{stem}_L{n}" for n in lags]


#: Columns of both teams, and of the side that a team plays on, by family.
PLAIN = {
    "record": ["total_wins", "total_losses", "games_played", *_lags("record", LAGS)],
    "point_differential": _lags("pts_diff_avg", LAGS),
    "norm_point_differential": _lags("norm_pts_diff_avg", LAGS),
    "sos": _lags("sos", LAGS),
    "sos_adj_record": _lags("sos_adj_record", LAGS),
    "gds": _lags("gds", GDS_LAGS),
    "distance": _lags("distance", DISTANCE_LAGS),
    "rested_days": ["rested_days"],
    "streak": ["streak"],
    "last_season_record": ["last_season_record"],
    "adjusted_last_season_record": ["adjusted_last_season_record"],
    "standings": list(FLAGS),
}
LOCATED = {
    "record": ["total_wins", "total_losses", "games_played", *_lags("record", LOCATION_LAGS)],
    "point_differential": _lags("pts_diff_avg", LOCATION_LAGS),
    "norm_point_differential": _lags("norm_pts_diff_avg", LOCATION_LAGS),
    "sos_adj_record": _lags("sos_adj_record", LOCATION_LAGS),
    "gds": _lags("gds", LOCATION_LAGS),
    "last_season_record": ["last_season_record"],
    "adjusted_last_season_record": ["adjusted_last_season_record"],
}
BY_DAY = ("east_record_adjusted", "west_record_adjusted", "games_played_east_vs_west", "east_record_at_east", "games_played_at_east", "west_record_at_west", "games_played_at_west")


class League:
    """Games in the catalogue's columns and teams (team, name, conf), and what follows from them.

    ``alpha`` is the exponent of a schedule's strength in adjusted records, ``beta`` what a game away from home counts
    more in its difficulty.
    """

    def __init__(self, games: DataFrame, teams: DataFrame, alpha: float = 1.0, beta: float = 0.1):
        self.spark: SparkSession = games.sparkSession
        self.teams, self.alpha, self.beta = teams.select("team", "conf"), alpha, beta
        self._games = games

    def sql(self, statement: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(statement, **frames)

    # ------------------------------------------------------------------ base

    @cached_property
    def games(self) -> DataFrame:
        """Games with both conferences; read by every family, so the lineage is cut here."""
        return cut(
            self.sql(
                """SELECT g.game_id, g.season, g.season_start, g.game_date, g.home, g.away, g.home_score, g.away_score, g.winner, g.label, g.arena,
                          h.conf AS home_conf, a.conf AS away_conf
                   FROM {games} g LEFT JOIN {teams} h ON h.team = g.home LEFT JOIN {teams} a ON a.team = g.away""",
                games=self._games, teams=self.teams,
            )
        )

    @cached_property
    def days(self) -> DataFrame:
        """A row per day of play: what the season held before it."""
        sums = ", ".join(f"COALESCE(SUM({x}) OVER (PARTITION BY season ORDER BY game_date {EARLIER}), 0) AS {x}" for x in ("pts", "n", "ee", "eg", "we", "wg"))
        return self.sql(
            f"""WITH x AS (SELECT season, game_date, home_score + away_score AS pts, home_conf <> away_conf AS across, home_conf,
                              CASE WHEN (winner = home) = (home_conf = 'East') THEN 1 ELSE 0 END AS east_win FROM {{games}}),
d AS (SELECT season, game_date, SUM(pts) AS pts, COUNT(*) AS n,
             SUM(CASE WHEN across AND home_conf = 'East' THEN east_win ELSE 0 END) AS ee, COUNT_IF(across AND home_conf = 'East') AS eg,
             SUM(CASE WHEN across AND home_conf = 'West' THEN east_win ELSE 0 END) AS we, COUNT_IF(across AND home_conf = 'West') AS wg
      FROM x GROUP BY season, game_date),
c AS (SELECT season, game_date, MIN(game_date) OVER (PARTITION BY season) AS lo, CAST(SUM(pts) OVER () AS DOUBLE) / SUM(n) OVER () AS m, {sums} FROM d),
p AS (SELECT *, CAST(ee AS DOUBLE) / NULLIF(eg, 0) AS at_east, CAST(we AS DOUBLE) / NULLIF(wg, 0) AS at_west,
             CAST(eg - ee AS DOUBLE) / NULLIF(eg, 0) AS west_at_east, CAST(wg - we AS DOUBLE) / NULLIF(wg, 0) AS west_at_west FROM c)
SELECT season, game_date, lo, m, pts AS pts_before, n AS n_before, {r('COALESCE((at_east + at_west) / 2, at_east, at_west, 0.0)', 4)} AS east_record_adjusted,
       {r('COALESCE((west_at_east + west_at_west) / 2, west_at_east, west_at_west, 0.0)', 4)} AS west_record_adjusted, eg + wg AS games_played_east_vs_west,
       {r('COALESCE(at_east, 0.0)', 4)} AS east_record_at_east, eg AS games_played_at_east,
       {r('COALESCE(west_at_west, 0.0)', 4)} AS west_record_at_west, wg AS games_played_at_west FROM p""",
            games=self.games,
        )

    @cached_property
    def team_games(self) -> DataFrame:
        """Two rows a game, with the season's first day and the league's mean of total points before the game."""
        today = f"OVER (PARTITION BY g.season, g.game_date ORDER BY g.game_id {EARLIER})"
        mean = f"(pts_before + COALESCE(SUM(g.home_score + g.away_score) {today}, 0)) / CAST(NULLIF(n_before + COUNT(*) {today}, 0) AS DOUBLE)"
        one = "named_struct('team', {0}, 'opp', {1}, 'conf', {0}_conf, 'opp_conf', {1}_conf, 'is_home', {2}, 'win', CASE WHEN {3} THEN 1 ELSE 0 END, 'diff', {0}_score - {1}_score)"
        rows = f"array({one.format('home', 'away', 1, 'winner = home')}, {one.format('away', 'home', 0, 'NOT (winner <=> home)')})"
        return cut(
            self.sql(
                f"""WITH l AS (SELECT g.*, d.lo, COALESCE({r(mean, 4)}, d.m) AS league_avg FROM {{games}} g JOIN {{days}} d ON d.season = g.season AND d.game_date = g.game_date)
SELECT game_id, season, season_start, game_date, lo, CAST(ROUND(COALESCE(t.diff / NULLIF(league_avg, 0), 0.0) * 1e9) AS BIGINT) AS norm, t.* FROM l LATERAL VIEW explode({rows}) e AS t""",
                games=self.games, days=self.days,
            )
        )

    # --------------------------------------------------------------- windows

    @cached_property
    def windows(self) -> DataFrame:
        """Every family that follows from a team's own games: one exchange, two sorts."""
        cols = [f"CAST({before('win')} AS BIGINT) AS total_wins", f"CAST({before('1 - win')} AS BIGINT) AS total_losses"]
        cols += [f"{r(previous('win', n), 4)} AS record_L{n}" for n in LAGS]
        cols += [f"COALESCE({r(previous('diff', n), 4)}, 0.0) AS pts_diff_avg_L{n}" for n in LAGS]
        cols += [f"COALESCE({r(previous('norm', n) + ' / 1e9', 6)}, 0.0) AS norm_pts_diff_avg_L{n}" for n in LAGS]
        cols += [f"CAST({before('win', SIDE)} AS BIGINT) AS total_wins_side", f"CAST({before('1 - win', SIDE)} AS BIGINT) AS total_losses_side", f"CAST(ROW_NUMBER() OVER ({SIDE}) - 1 AS BIGINT) AS games_played_side"]
        cols += [f"{r(previous('win', n, SIDE), 4)} AS record_L{n}_side" for n in LOCATION_LAGS]
        cols += [f"COALESCE({r(previous('diff', n, SIDE), 4)}, 0.0) AS pts_diff_avg_L{n}_side" for n in LOCATION_LAGS]
        cols += [f"COALESCE({r(previous('norm', n, SIDE) + ' / 1e9', 6)}, 0.0) AS norm_pts_diff_avg_L{n}_side" for n in LOCATION_LAGS]
        kept = ", ".join(c.rsplit(" AS ", 1)[1] for c in cols)
        legs = f"OVER ({W} ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)"
        far = ", ".join(f"{r(f'CAST(SUM(miles) {legs.format(n - 1)} AS DOUBLE) / COUNT(*) {legs.format(n - 1)}', 0)} AS distance_L{n}" for n in DISTANCE_LAGS)
        return self.sql(
            f"""WITH a AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, CASE WHEN is_home = 1 THEN team ELSE opp END AS city, LAG(win) OVER ({W}) AS last_win, LAG(is_home) OVER ({W}) AS last_home,
            LAG(game_date) OVER ({W}) AS last_day, MAX(is_home) OVER (PARTITION BY season, team) AS has_home, {", ".join(cols)} FROM {{tg}}),
b AS (SELECT *, LAG(city) OVER ({W}) AS last_city, CASE WHEN last_win <=> LAG(last_win) OVER ({W}) AND rn > 1 THEN 0 ELSE 1 END AS turn, CASE WHEN is_home <=> last_home THEN 0 ELSE 1 END AS moved FROM a),
c AS (SELECT *, MAX(CASE WHEN turn = 1 THEN rn END) OVER ({W} {SO_FAR}) AS run, MAX(CASE WHEN moved = 1 THEN CASE WHEN rn = 1 AND is_home = 1 THEN lo ELSE game_date END END) OVER ({W} {SO_FAR}) AS since,
             CASE WHEN game_date = lo THEN city WHEN date_add(last_day, 1) = game_date THEN last_city WHEN city = team THEN team ELSE COALESCE(last_city, team) END AS origin FROM b),
e AS (SELECT *, datediff(game_date, since) + 1 AS stay, CASE WHEN origin = city THEN 0 ELSE (greatest(city, origin) - least(city, origin)) * 137 % 2500 + 50 END AS miles FROM c)
SELECT {", ".join(KEY)}, opp, conf, opp_conf, is_home, win, diff, rn, has_home, CAST(rn - 1 AS BIGINT) AS games_played, {kept},
       CAST(CASE WHEN last_win IS NULL THEN 0 ELSE (2 * last_win - 1) * (rn - run + 1) END AS BIGINT) AS streak,
       CAST(CASE WHEN last_day IS NULL THEN datediff(game_date, lo) ELSE datediff(game_date, last_day) - 1 END AS BIGINT) AS rested_days,
       CAST(CASE WHEN is_home = 0 THEN 0 WHEN stay > 30 THEN 1 ELSE stay END AS BIGINT) AS days_at_home,
       CAST(CASE WHEN is_home = 1 THEN 0 WHEN stay > 30 THEN 1 ELSE stay END AS BIGINT) AS days_on_road, CAST(miles AS BIGINT) AS miles, {far} FROM e""",
            tg=self.team_games,
        )

    # ------------------------------------------------------ schedule strength

    @cached_property
    def form(self) -> DataFrame:
        """(season, team, game_date, pct): a team's share of wins before each of the season's days of play, carried forward by one sort."""
        form = self.sql(
            f"""WITH st AS (SELECT season, team, game_date, LEAD(game_date) OVER ({W}) AS nxt,
            CAST(ROUND(CAST(SUM(win) OVER ({W} {SO_FAR}) AS DOUBLE) / ROW_NUMBER() OVER ({W}) * 1e9) AS BIGINT) AS pct FROM {{tg}}),
closed AS (SELECT season, team, game_date, pct FROM st WHERE nxt IS NULL OR nxt > game_date),
grid AS (SELECT q.season, q.team, p.game_date FROM (SELECT DISTINCT season, team FROM {{tg}}) q JOIN (SELECT DISTINCT season, game_date FROM {{games}}) p ON p.season = q.season)
SELECT g.season, g.team, g.game_date, last(c.pct, true) OVER (PARTITION BY g.season, g.team ORDER BY g.game_date {EARLIER}) AS pct
FROM grid g LEFT JOIN closed c ON c.season = g.season AND c.team = g.team AND c.game_date = g.game_date""",
            tg=self.team_games, games=self.games,
        )
        form = cut(form.filter("pct IS NOT NULL"))
        return form.hint("broadcast") if form.count() <= BROADCAST_FORMS else form

    def schedule_strength(self, lags: tuple[int, ...] = LAGS, least: int = 3) -> DataFrame:
        """(game_id, season, team, game_date, sos_L...): mean share of wins, as of the game, of the last opponents; null under ``least`` of them."""
        sums = ", ".join(f"SUM(CASE WHEN back < {n} THEN pct END) AS s{n}, COUNT(CASE WHEN back < {n} THEN pct END) AS c{n}" for n in lags)
        cols = ", ".join(f"CASE WHEN c{n} >= {least} THEN {r(f'CAST(s{n} AS DOUBLE) / c{n} / 1e9', 4)} END AS sos_L{n}" for n in lags)
        return self.sql(
            f"""WITH st AS (SELECT {", ".join(KEY)}, collect_list(opp) OVER ({W} ROWS BETWEEN {max(lags)} PRECEDING AND 1 PRECEDING) AS met FROM {{tg}}),
one AS (SELECT {", ".join(KEY)}, back, met_team FROM st LATERAL VIEW OUTER posexplode(reverse(met)) e AS back, met_team),
sums AS (SELECT o.game_id, o.season, o.team, o.game_date, {sums} FROM one o LEFT JOIN {{form}} f ON f.season = o.season AND f.team = o.met_team AND f.game_date = o.game_date
         GROUP BY o.season, o.team, o.game_date, o.game_id)
SELECT {", ".join(KEY)}, {cols} FROM sums""",
            tg=self.team_games, form=self.form,
        )

    @cached_property
    def strength(self) -> DataFrame:
        """Schedule strength, adjusted records of both kinds, a game's difficulty and its means: one narrow row per team and game."""
        every = tuple(sorted({*LAGS, *LOCATION_LAGS}))
        sos = cut(self.schedule_strength(every, 1))
        rec = ", ".join([f"{r(previous('win', n), 4)} AS record_L{n}" for n in LAGS] + [f"{r(previous('win', n, SIDE), 4)} AS side_L{n}" for n in LOCATION_LAGS])
        mean = "(SUM(CAST(ROUND(sos_L{n} * 1e4) AS BIGINT)) OVER ({w}) / CAST(NULLIF(COUNT(sos_L{n}) OVER ({w}), 0) AS DOUBLE) / 1e4)"
        power = "{x}" if self.alpha == 1 else f"POWER({{x}}, {self.alpha!r}D)"
        ratio = {(n, w): power.format(x=f"(s.sos_L{n} / NULLIF({mean.format(n=n, w=w)}, 0))") for n in every for w in ("PARTITION BY r.season, r.game_date", "PARTITION BY r.season, r.game_date, r.is_home")}
        adjusted = [f"{r(f'r.record_L{n} * {ratio[n, "PARTITION BY r.season, r.game_date"]}', 4)} AS sos_adj_record_L{n}" for n in LAGS]
        adjusted += [f"{r(f'r.side_L{n} * {ratio[n, "PARTITION BY r.season, r.game_date, r.is_home"]}', 4)} AS sos_adj_record_L{n}_side" for n in LOCATION_LAGS]
        names = [a.rsplit(" AS ", 1)[1] for a in adjusted]
        other = "MAX(CASE WHEN is_home = {s} THEN {x} END) OVER (PARTITION BY game_id)"
        opposite = "CASE WHEN is_home = 1 THEN {a} ELSE {h} END".format(a=other.format(s=0, x="own"), h=other.format(s=1, x="own"))
        raw = r(f"CASE WHEN win = 1 THEN q * (1 + {self.beta!r}D * (1 - is_home)) ELSE -(1 - q) * (1 + {self.beta!r}D * is_home) END", 4)
        gds = [f"{r(previous('units', n) + ' / 1e4', 4)} AS gds_L{n}" for n in GDS_LAGS] + [f"{r(previous('units', n, SIDE) + ' / 1e4', 4)} AS gds_L{n}_side" for n in LOCATION_LAGS]
        carried = ", ".join([*_lags("sos", LAGS), *names])
        return self.sql(
            f"""WITH rec AS (SELECT {", ".join(KEY)}, is_home, win, CAST({before('win')} AS DOUBLE) / NULLIF(ROW_NUMBER() OVER ({W}) - 1, 0) AS pct, {rec} FROM {{tg}}),
adj AS (SELECT r.game_id, r.season, r.team, r.game_date, r.is_home, r.win, r.pct, {", ".join(_lags("s.sos", LAGS))}, {", ".join(adjusted)} FROM rec r JOIN {{sos}} s ON s.game_id = r.game_id AND s.team = r.team),
own AS (SELECT *, COALESCE(sos_adj_record_L{SEASON}, pct) AS own FROM adj),
opp AS (SELECT *, {opposite} AS q0 FROM own),
quality AS (SELECT *, CASE WHEN q0 IS NOT NULL THEN least(greatest(q0, 0.0D), 1.0D) END AS q FROM opp),
g AS (SELECT *, CAST(ROUND({raw} * 1e4) AS BIGINT) AS units FROM quality)
SELECT {", ".join(KEY)}, is_home, {carried}, {r('units / 1e4', 4)} AS gds, {", ".join(gds)} FROM g""",
            tg=self.team_games, sos=sos,
        )

    def _side_of(self, stem: str, lags: tuple[int, ...], side: int | None, extra: str = "") -> DataFrame:
        """A family of ``strength``: over all games, or over home (1) or away (0) games, under the same names."""
        cols = ", ".join(f"{stem}_L{n}{'' if side is None else '_side'} AS {stem}_L{n}" for n in lags)
        where = "" if side is None else f"WHERE is_home = {side}"
        return self.sql(f"SELECT {', '.join(KEY)}{extra}, {cols} FROM {{strength}} {where}", strength=self.strength)

    def sos_adjusted_record(self, side: int | None = None) -> DataFrame:
        return self._side_of("sos_adj_record", LAGS if side is None else LOCATION_LAGS, side)

    def game_difficulty(self, side: int | None = None) -> DataFrame:
        return self._side_of("gds", GDS_LAGS if side is None else LOCATION_LAGS, side, ", gds")

    def travel_distance(self) -> DataFrame:
        """Teams that never play at home have no place to start from, and no row."""
        return self.sql(f"SELECT {', '.join(KEY)}, miles, {', '.join(_lags('distance', DISTANCE_LAGS))} FROM {{w}} WHERE has_home = 1", w=self.windows)

    def days_home_road(self) -> DataFrame:
        return self.sql(f"SELECT {', '.join(KEY)}, days_at_home, days_on_road FROM {{w}} WHERE has_home = 1", w=self.windows)

    # ------------------------------------------------------------ last season

    @cached_property
    def last_season(self) -> DataFrame:
        """(season, team) and what the season before it left; the least of that season's teams stands in for a team it lacks."""
        sides = {"": "1 = 1", "_home": "is_home = 1", "_away": "is_home = 0"}
        shares = ", ".join(f"{r(f'SUM(CASE WHEN {c} THEN win END) / CAST(NULLIF(COUNT_IF({c}), 0) AS DOUBLE)', 4)} AS p{s}" for s, c in sides.items())
        mean = "(SUM(CASE WHEN p{s} IS NOT NULL THEN CAST(ROUND(sos * 1e4) AS BIGINT) END) OVER (PARTITION BY season) / CAST(NULLIF(COUNT(CASE WHEN p{s} IS NOT NULL THEN sos END) OVER (PARTITION BY season), 0) AS DOUBLE) / 1e4)"
        ratio = "(sos / NULLIF({m}, 0))" if self.alpha == 1 else f"POWER(sos / NULLIF({{m}}, 0), {self.alpha!r}D)"
        adjusted = ", ".join(f"{r('p{s} * {x}'.format(s=s, x=ratio.format(m=mean.format(s=s))), 4)} AS a{s}" for s in sides)
        low = ", ".join(f"MIN(p{s}) OVER (PARTITION BY season) AS low{s}" for s in sides)
        plain = ", ".join(f"COALESCE(b.p{s}, l.low{s}) AS last_season{s}_record" for s in sides)
        # Of the adjusted ones the least is taken among the teams of the season itself that the season before has.
        least = ", ".join(
            f"CASE WHEN {'TRUE' if not s else f'n.has{s}'} THEN COALESCE(b.a{s}, MIN(CASE WHEN {'TRUE' if not s else f'n.has{s}'} THEN b.a{s} END) OVER (PARTITION BY n.season)) END AS adjusted_last_season{s}_record" for s in sides
        )
        return self.sql(
            f"""WITH t AS (SELECT season, season_start, team, COUNT_IF(is_home = 1) > 0 AS has_home, COUNT_IF(is_home = 0) > 0 AS has_away, {shares} FROM {{tg}} GROUP BY season, season_start, team),
f AS (SELECT season, team, max_by(sos_L{SEASON}, struct(game_date, game_id)) AS sos FROM {{strength}} WHERE sos_L{SEASON} IS NOT NULL GROUP BY season, team),
j AS (SELECT t.*, f.sos FROM t LEFT JOIN f ON f.season = t.season AND f.team = t.team),
b AS (SELECT *, {adjusted}, {low} FROM j),
l AS (SELECT season_start, {", ".join(f"MIN(p{s}) AS low{s}" for s in sides)} FROM t GROUP BY season_start)
SELECT n.season, n.team, n.has_home, n.has_away, {plain}, {least} FROM t n LEFT JOIN b ON b.team = n.team AND b.season_start = n.season_start - 1 LEFT JOIN l ON l.season_start = n.season_start - 1""",
            tg=self.team_games, strength=self.strength,
        )

    def last_season_adjusted(self, side: str = "") -> DataFrame:
        """``side``: "", "_home" or "_away"; a team without games on that side has no row."""
        where = f"WHERE has{side}" if side else ""
        return self.sql(f"SELECT season, team, adjusted_last_season{side}_record FROM {{l}} {where}", l=self.last_season)

    # -------------------------------------------------------------- standings

    @cached_property
    def snapshots(self) -> DataFrame:
        """A row per season, conference, day of play and team: what the team had before the day, its rank and flags."""
        total = ", ".join(f"SUM({x}) OVER ({W} {SO_FAR}) AS {n}" for n, x in (("wins", "win"), ("cw", "CASE WHEN conf = opp_conf THEN win ELSE 0 END"), ("cg", "CASE WHEN conf = opp_conf THEN 1 ELSE 0 END"), ("pd", "diff")))
        group = "PARTITION BY season, conf, game_date"
        o = f"{group} ORDER BY conf_rank"
        rank_key = "wins DESC, losses, h2h DESC, cpct DESC, pd DESC, team"
        behind = "(({a} - wins) + (losses - {b})) / 2.0D"
        above = {k: f"{k}(wins) OVER ({o})" for k in ("FIRST_VALUE", "LAG", "LEAD")}
        below = {k: f"{k}(losses) OVER ({o})" for k in ("FIRST_VALUE", "LAG", "LEAD")}
        count = "size(filter(others, x -> {}))"
        return self.sql(
            f"""WITH cum AS (SELECT season, team, game_date, LEAD(game_date) OVER ({W}) AS nxt, ROW_NUMBER() OVER ({W}) AS played, {total} FROM {{tg}} WHERE conf IS NOT NULL AND opp_conf IS NOT NULL),
closed AS (SELECT season, team, game_date, struct(wins, played, cw, cg, pd) AS s FROM cum WHERE nxt IS NULL OR nxt > game_date),
len AS (SELECT season, CAST(floor(2.0 * COUNT(DISTINCT game_id) / COUNT(DISTINCT team)) AS BIGINT) AS length FROM {{tg}} GROUP BY season),
grid AS (SELECT dt.season, dt.conf, dt.game_date, m.team FROM (SELECT DISTINCT season, conf, game_date FROM {{tg}} WHERE conf IS NOT NULL AND opp_conf IS NOT NULL) dt
         JOIN (SELECT DISTINCT season, conf, team FROM {{tg}} WHERE conf IS NOT NULL AND opp_conf IS NOT NULL) m ON m.season = dt.season AND m.conf = dt.conf),
at AS (SELECT g.*, last(c.s, true) OVER (PARTITION BY g.season, g.team ORDER BY g.game_date {EARLIER}) AS s FROM grid g LEFT JOIN closed c ON c.season = g.season AND c.team = g.team AND c.game_date = g.game_date),
snap AS (SELECT a.season, a.conf, a.game_date, a.team, COALESCE(s.wins, 0) AS wins, COALESCE(s.played - s.wins, 0) AS losses, COALESCE(CAST(s.cw AS DOUBLE) / NULLIF(s.cg, 0), 0.0D) AS cpct,
                COALESCE(s.pd, 0) AS pd, greatest(l.length - COALESCE(s.played, 0), 0) AS remaining FROM at a JOIN len l ON l.season = a.season),
tied AS (SELECT *, collect_list(team) OVER (PARTITION BY season, conf, game_date, wins, losses) AS equals FROM snap),
pair AS (SELECT season, conf, game_date, team, rival FROM tied LATERAL VIEW explode(equals) e AS rival WHERE size(equals) > 1 AND rival <> team),
won AS (SELECT season, team, opp, game_date FROM {{tg}} WHERE conf = opp_conf AND win = 1),
h AS (SELECT p.season, p.conf, p.game_date, p.team, COUNT(*) AS h2h FROM pair p JOIN won w ON w.season = p.season AND w.team = p.team AND w.opp = p.rival AND w.game_date < p.game_date
      GROUP BY p.season, p.conf, p.game_date, p.team),
full AS (SELECT s.*, COALESCE(h.h2h, 0) AS h2h FROM snap s LEFT JOIN h ON h.season = s.season AND h.conf = s.conf AND h.game_date = s.game_date AND h.team = s.team),
ranked AS (SELECT *, ROW_NUMBER() OVER ({group} ORDER BY {rank_key}) AS conf_rank FROM full),
seen AS (SELECT *, collect_list(struct(team, wins, remaining, conf_rank)) OVER ({group}) AS others,
                {behind.format(a=above["FIRST_VALUE"], b=below["FIRST_VALUE"])} AS games_behind_leader, {behind.format(a=above["LAG"], b=below["LAG"])} AS games_behind_above,
                ((wins - {above["LEAD"]}) + ({below["LEAD"]} - losses)) / 2.0D AS games_ahead_of_below FROM ranked),
flag AS (SELECT *, least(CASE WHEN CAST(left(season, 4) AS BIGINT) < 2020 THEN 8 ELSE 10 END, size(others)) AS cutoff,
                {count.format("x.team <> team AND x.wins + x.remaining >= wins")} AS can_catch, {count.format("x.team <> team AND x.wins > wins + remaining")} AS out_of_reach,
                {count.format("x.conf_rank > conf_rank AND x.wins + x.remaining >= wins")} AS below_threat, {count.format("x.conf_rank < conf_rank AND x.wins <= wins + remaining")} AS above_reach FROM seen)
SELECT season, conf, game_date, team, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(conf_rank AS BIGINT) AS conf_rank, games_behind_leader, games_behind_above, games_ahead_of_below,
       CAST(can_catch < cutoff AS BIGINT) AS clinched_playoff_berth, CAST(out_of_reach >= cutoff AS BIGINT) AS eliminated_from_playoffs, CAST(below_threat = 0 AND above_reach = 0 AS BIGINT) AS clinched_final_seed,
       CAST(out_of_reach >= cutoff OR (below_threat = 0 AND above_reach = 0) AS BIGINT) AS indifference_flag FROM flag""",
            tg=self.team_games,
        )

    def _played(self, columns: str) -> DataFrame:
        return self.sql(
            f"SELECT t.game_id, s.season, s.team, s.game_date, {columns} FROM {{tg}} t JOIN {{s}} s ON s.season = t.season AND s.team = t.team AND s.game_date = t.game_date",
            tg=self.team_games, s=self.snapshots,
        )

    def standings(self) -> DataFrame:
        return self._played("s.conf, s.wins, s.losses, s.conf_rank, s.games_behind_leader AS behind_leader, s.games_behind_above AS behind_above, s.games_ahead_of_below AS lead_below")

    def playoff_flags(self) -> DataFrame:
        return self._played("s.clinched_playoff_berth AS clinched, s.eliminated_from_playoffs AS eliminated, s.clinched_final_seed AS seed_locked, s.indifference_flag")

    def neutral(self) -> DataFrame:
        """(game_id, neutral_court): 1 where the arena is none of those that hold a fifth of the home team's games of the season."""
        return self.sql(
            """WITH n AS (SELECT season, home, arena, COUNT(*) AS n FROM {games} GROUP BY season, home, arena),
p AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY season, home) AS part FROM n),
own AS (SELECT season, home, collect_list(arena) AS arenas FROM p WHERE part >= 0.2 GROUP BY season, home)
SELECT g.game_id, CAST(CASE WHEN o.arenas IS NULL OR array_contains(o.arenas, g.arena) THEN 0 ELSE 1 END AS BIGINT) AS neutral_court
FROM {games} g LEFT JOIN own o ON o.season = g.season AND o.home = g.home""",
            games=self.games,
        )

    # ------------------------------------------------------------- wide table

    @cached_property
    def sides(self) -> DataFrame:
        """Everything known of a team before a game, a row per team and game."""
        strength = [*PLAIN["sos"], *PLAIN["sos_adj_record"], *PLAIN["gds"], *(f"{c}_side" for g in ("sos_adj_record", "gds") for c in LOCATED[g])]
        last = [*(f"l.{c}" for c in PLAIN["last_season_record"] + PLAIN["adjusted_last_season_record"])]
        last += [f"CASE WHEN w.is_home = 1 THEN l.{p}last_season_home_record ELSE l.{p}last_season_away_record END AS {p}last_season_record_side" for p in ("", "adjusted_")]
        return self.sql(
            f"""SELECT w.*, {", ".join(f"x.{c}" for c in strength)}, {", ".join(f"p.{c}" for c in FLAGS)}, {", ".join(last)} FROM {{w}} w JOIN {{x}} x ON x.game_id = w.game_id AND x.team = w.team
LEFT JOIN {{p}} p ON p.season = w.season AND p.team = w.team AND p.game_date = w.game_date LEFT JOIN {{l}} l ON l.season = w.season AND l.team = w.team""",
            w=self.windows, x=self.strength, p=self.snapshots, l=self.last_season,
        )

    def wide(self) -> DataFrame:
        """A row per game: both teams' families as ``_HT`` and ``_VT``, those of the side they play on as ``_HT_at_home`` and ``_VT_on_road``."""
        self.strength = cut(self.strength)  # read twice: by itself, and by the season before
        placed = {"distance"}  # teams without a home have none
        cols = []
        for side, tag, located in (("h", "HT", "HT_at_home"), ("v", "VT", "VT_on_road")):
            for group, names in PLAIN.items():
                for c in names:
                    cols.append(f"{f'CASE WHEN {side}.has_home = 1 THEN {side}.{c} END' if group in placed else f'{side}.{c}'} AS {c}_{tag}")
            cols += [f"{side}.{c}_side AS {c}_{located}" for names in LOCATED.values() for c in names]
        cols += ["CASE WHEN h.has_home = 1 THEN h.days_at_home ELSE 0 END AS days_at_home", "CASE WHEN v.has_home = 1 THEN v.days_on_road ELSE 0 END AS days_on_road"]
        names = ", ".join(c for c in self.sides.columns if c not in ("season", "game_date", "game_id"))
        return self.sql(
            f"""WITH s AS (SELECT game_id, struct(team, {names}) AS t, is_home FROM {{sides}}),
both AS (SELECT game_id, t AS h, LEAD(t) OVER (PARTITION BY game_id ORDER BY is_home DESC) AS v, is_home FROM s),
one AS (SELECT * FROM both WHERE is_home = 1)
SELECT one.game_id, g.season, g.game_date, g.home, g.away, g.home_conf, g.away_conf, CAST(CASE WHEN g.winner = g.home THEN 1 ELSE 0 END AS BIGINT) AS win, g.home_score - g.away_score AS pts_diff,
       COALESCE(g.label = 'Neutral Cup', false) AS is_neutral_court_game, n.neutral_court, {", ".join(f"d.{c}" for c in BY_DAY)}, {", ".join(cols)}
FROM one JOIN {{games}} g ON g.game_id = one.game_id JOIN {{days}} d ON d.season = g.season AND d.game_date = g.game_date JOIN {{neutral}} n ON n.game_id = g.game_id""",
            sides=self.sides.drop("season", "game_date"), games=self.games, days=self.days, neutral=self.neutral(),
        )
