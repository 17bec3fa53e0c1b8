"""The wide and the delta table as one statement: every family's own statement, joined side by side.

This is the definition that ``League.wide`` is held against; it shares no formulation with it.
"""

from __future__ import annotations

from collections.abc import Callable

from courtlake.functions.dialect import Dialect
from courtlake.plans import features as f
from courtlake.plans.base import TEAM_GAMES, TEAMS
from courtlake.plans.league import BY_DAY, FLAGS, LOCATED, PLAIN
from courtlake.plans.tables import neutral_court

#: The standings' columns under the names of the wide table.
STANDING_NAMES = dict(zip(FLAGS, ("conf_rank", "behind_leader", "behind_above", "lead_below", "clinched", "eliminated", "seed_locked", "indifference_flag"), strict=True))


def _sos(d: Dialect) -> str:
    return f"WITH {TEAM_GAMES}, {f._sos_cte(d, f.LAGS, 1)} SELECT * FROM sos"


def _body(plan: Callable[[Dialect], str], d: Dialect) -> str:
    """A family's statement on the games and teams that the statement around it has."""
    text = plan(d)
    for known in (f"{TEAM_GAMES}, {TEAMS}", TEAM_GAMES, f.GAMES):
        if known in text:
            head, tail = text.split(known, 1)
            tail = tail.lstrip()
            return "WITH " + tail[1:] if tail.startswith(",") else head.replace("WITH", "", 1) + tail
    return text


#: By family: the statement over all games, at home and on the road, and whether it is by game or by season.
ROWS = {
    "record": (f.record_rolling, f.home_record_rolling, f.away_record_rolling),
    "point_differential": (f.pts_diff_rolling, f.home_pts_diff_rolling, f.away_pts_diff_rolling),
    "norm_point_differential": (f.norm_pts_diff_rolling, f.home_norm_pts_diff_rolling, f.away_norm_pts_diff_rolling),
    "sos": (_sos,),
    "sos_adj_record": (f.sos_adjusted_record, f.sos_adjusted_home_record, f.sos_adjusted_away_record),
    "gds": (f.game_difficulty, f.gds_home, f.gds_away),
    "distance": (f.travel_distance,),
    "rested_days": (f.rested_days,),
    "streak": (f.streak,),
    "standings": (f.standings,),
    "flags": (f.playoff_flags,),
    "days": (f.days_home_road,),
}
SEASONS = {
    "last_season_record": (f.last_season_record, f.last_season_home_record, f.last_season_away_record),
    "adjusted_last_season_record": (f.adjusted_last_season_record, f.adjusted_last_season_home_record, f.adjusted_last_season_away_record),
}


def wide_features(d: Dialect) -> str:
    """The wide table, in the order of ``League.wide``."""
    ctes, joins = [], []
    plain: dict[str, list[str]] = {"HT": [], "VT": []}
    located: dict[str, list[str]] = {"HT": [], "VT": []}
    once = "" if d.spark else "MATERIALIZED "

    def add(name: str, plan: Callable[[Dialect], str], team: str, by_season: bool) -> str:
        alias = f"{name}_{team}"
        if not any(c.startswith(f"f_{name} AS") for c in ctes):
            ctes.append(f"f_{name} AS {once}({_body(plan, d)})")
        on = f"{alias}.season = g.season" if by_season else f"{alias}.game_id = g.game_id"
        joins.append(f"LEFT JOIN f_{name} {alias} ON {on} AND {alias}.team = g.{team}")
        return alias

    for group, names in PLAIN.items():
        plans = SEASONS.get(group) or ROWS[group]
        for team, tag, side_tag, k in (("home", "HT", "HT_at_home", 1), ("away", "VT", "VT_on_road", 2)):
            alias = add(group, plans[0], team, group in SEASONS)
            flags = add("flags", f.playoff_flags, team, False) if group == "standings" else alias
            for c in names:
                source = STANDING_NAMES.get(c, c)
                plain[tag].append(f"{flags if source in ('clinched', 'eliminated', 'seed_locked', 'indifference_flag') else alias}.{source} AS {c}_{tag}")
            if len(plans) > 1:
                side = add(f"{group}_{team}", plans[k], team, group in SEASONS)
                for c in LOCATED[group]:
                    source = c if group not in SEASONS else c.replace("season_record", f"season_{team}_record")
                    located[tag].append(f"{side}.{source} AS {c}_{side_tag}")
    cols = plain["HT"] + located["HT"] + plain["VT"] + located["VT"]
    cols += [f"COALESCE({add('days', f.days_home_road, team, False)}.{c}, 0) AS {c}" for team, c in (("home", "days_at_home"), ("away", "days_on_road"))]
    day = {
        "east_record_adjusted": d.r(f.EAST, 4), "west_record_adjusted": d.r(f.WEST, 4), "games_played_east_vs_west": "CAST(eg + wg AS BIGINT)",
        "east_record_at_east": d.r("COALESCE(at_east, 0.0)", 4), "games_played_at_east": "CAST(eg AS BIGINT)",
        "west_record_at_west": d.r("COALESCE(west_at_west, 0.0)", 4), "games_played_at_west": "CAST(wg AS BIGINT)",
    }
    across = _body(lambda x: f._cross(x, "SELECT * FROM pct"), d).replace(f"{TEAMS},", "", 1)
    ctes.append(f"f_days_of AS ({across})")
    ctes.append(f"f_neutral AS ({_body(neutral_court, d)})")
    return f"""WITH {TEAM_GAMES}, {TEAMS}, {", ".join(ctes)}
SELECT g.game_id, g.season, g.game_date, g.home, g.away, th.conf AS home_conf, ta.conf AS away_conf, CAST(CASE WHEN g.winner = g.home THEN 1 ELSE 0 END AS BIGINT) AS win,
       CAST(g.home_score - g.away_score AS BIGINT) AS pts_diff, COALESCE(g.label = 'Neutral Cup', false) AS is_neutral_court_game, n.neutral_court,
       {", ".join(f"{day[c]} AS {c}" for c in BY_DAY)}, {", ".join(cols)}
FROM games g JOIN teams th ON th.team = g.home JOIN teams ta ON ta.team = g.away JOIN f_days_of d ON d.season = g.season AND d.day = g.game_date JOIN f_neutral n ON n.game_id = g.game_id
{" ".join(joins)}"""


def delta_features(d: Dialect) -> str:
    """All deltas of the wide table, by name: the difference of the sides, but for two that the settings define otherwise."""
    cols = []
    for group, names in PLAIN.items():
        for c in names if group not in ("record", "standings") else [x for x in names if x.startswith("record_")] if group == "record" else ["indifference_flag"]:
            a, b = ("VT", "HT") if c == "indifference_flag" else ("HT", "VT")
            cols.append(f"{c}_{a} - {c}_{b} AS {c}_delta")
    for group, names in LOCATED.items():
        cols += [f"{c}_HT_at_home - {c}_VT_on_road AS {c}_at_location_delta" for c in names if group != "record" or c.startswith("record_")]
    east = "(CASE WHEN home_conf = 'East' THEN 1 ELSE 0 END - CASE WHEN away_conf = 'East' THEN 1 ELSE 0 END)"
    cols += ["days_at_home + days_on_road AS days_at_home_delta", "neutral_court", f"{east} * (east_record_adjusted - west_record_adjusted) AS conference_diff_home_advantage_pct"]
    return f"SELECT game_id, {', '.join(cols)} FROM ({wide_features(d)}) w"
