"""The league's pipeline against worked examples and against brute force that walks the calendar game by game."""

import collections
import datetime

import pytest

from courtlake.catalog import QUERIES, league_of
from courtlake.plans.league import League

SF = "/root/testdata/sf0.001"
GAMES = "game_id long, game_date date, season string, season_start long, home long, away long, home_score long, away_score long, winner long, label string, arena long"


def day(n):
    return datetime.date(2025, 1, n)


def league(spark, rows, confs=None, **options):
    """Games (id, day, home, away, winner, home score, away score[, season start])."""
    games = [(i, day(d), f"{(s := (more or [2024])[0])}/{(s + 1) % 100:02d}", s, h, a, hs, aws, w, None, h) for i, d, h, a, w, hs, aws, *more in rows]
    teams = sorted({t for g in rows for t in g[2:4]})
    return League(spark.createDataFrame(games, GAMES), spark.createDataFrame([(t, (confs or {}).get(t, "East")) for t in teams], "team long, conf string"), **options)


FOUR = [(1, 1, 1, 2, 1, 100, 90), (2, 2, 3, 4, 3, 100, 90), (3, 3, 1, 3, 1, 100, 90), (4, 4, 2, 4, 2, 100, 90), (5, 5, 4, 1, 1, 90, 100), (6, 6, 2, 3, 3, 90, 100), (7, 7, 1, 4, 1, 100, 90), (8, 8, 3, 2, 3, 100, 90)]
SIX = [(1, 1, 1, 2, 1, 100, 90), (2, 1, 3, 4, 3, 100, 90), (3, 2, 2, 4, 2, 100, 90), (4, 3, 1, 2, 2, 90, 100), (5, 3, 3, 4, 4, 90, 100), (6, 4, 1, 3, 1, 100, 90)]


def test_strength_of_schedule_by_hand(spark):
    def sos(lags, least):
        return {(r.game_id, r.team): r.asDict() for r in league(spark, FOUR).schedule_strength(lags, least).collect()}

    at = sos((2, 10), 3)
    assert (len(at), at[7, 1]["sos_L10"], at[8, 3]["sos_L10"]) == (16, 0.3333, 0.4444)
    assert [at[g, 1]["sos_L10"] for g in (1, 3, 5)] == [None] * 3 and at[7, 1]["sos_L2"] is None
    at = sos((2, 10), 2)
    assert at[5, 1]["sos_L10"] == 0.5 and at[7, 1]["sos_L2"] == 0.3333
    again = league(spark, FOUR + [(9, 9, 1, 2, 1, 100, 90, 2025)]).schedule_strength((10,), 1)
    assert {r.sos_L10 for r in again.filter("game_id = 9").collect()} == {None}


def test_adjusted_record_by_hand(spark):
    def adjusted(alpha):
        return {r.team: r for r in league(spark, SIX, alpha=alpha).sos_adjusted_record().filter("game_id = 6").collect()}

    one, none = adjusted(1.0), adjusted(0.0)
    assert {t: r.sos_adj_record_L13 for t, r in one.items()} == {1: 0.6667, 3: 0.3333}
    assert {t: r.sos_adj_record_L13 for t, r in none.items()} == {1: 0.5, 3: 0.5}
    home, away = (league(spark, SIX).sos_adjusted_record(s) for s in (1, 0))
    assert home.count() == away.count() == 6 and not home.join(away, ["game_id", "team"]).count()


def test_difficulty_by_hand(spark):
    rows = [(i, i, 1, 2, w, 100 if w == 1 else 90, 90 if w == 1 else 100) for i, w in enumerate((1, 1, 2, 2, 1), 1)]
    plain, uneven = (league(spark, rows, beta=b).game_difficulty().orderBy("game_id", "team").collect() for b in (0.0, 0.15))
    one = {b: [r for r in table if r.team == 1] for b, table in ((0, plain), (0.15, uneven))}
    # The opponent has lost all games before the second and third.  Before the fourth its record is 1/3 against a team
    # of 2/3, and the mean strength of that day is 1/2, so its quality is 4/9; before the fifth all are 1/2.
    assert [r.gds for r in one[0]] == [None, 0.0, -1.0, -0.5556, 0.5]
    assert one[0][3].gds_L3 == pytest.approx((0.0 - 1.0) / 2) and one[0][0].gds_L3 is None and one[0][1].gds_L3 is None
    # At home a win counts the same and a loss more; the visitor's win counts more.
    assert one[0.15][2].gds == pytest.approx(-1.15) and one[0.15][1].gds == 0.0
    two = [[r for r in table if r.team == 2][3].gds for table in (plain, uneven)]
    assert two == [0.4444, 0.5111]


def test_standings_by_hand(spark):
    rows = [(1, 1, 1, 2, 1, 100, 90), (2, 1, 3, 4, 3, 90, 80), (3, 2, 2, 4, 2, 90, 100), (4, 3, 1, 2, 2, 80, 100), (5, 3, 3, 4, 4, 100, 90), (6, 4, 1, 3, 1, 110, 90)]
    got = league(spark, rows).standings().collect()
    assert collections.Counter(r.team for r in got) == {1: 3, 2: 3, 3: 3, 4: 3}
    last = {r.team: r for r in got if r.game_id == 6}
    assert (last[1].wins, last[1].losses, last[3].wins, last[3].losses) == (1, 1, 1, 1)
    assert sorted((last[1].conf_rank, last[3].conf_rank)) == sorted({last[1].conf_rank, last[3].conf_rank})


@pytest.fixture(scope="module")
def real(spark):
    return league_of(spark, SF)


@pytest.fixture(scope="module")
def played(real):
    return sorted(real.team_games.collect(), key=lambda g: (g.season, g.team, g.game_date, g.game_id))


def of_team(played):
    out = collections.defaultdict(list)
    for g in played:
        out[g.season, g.team].append(g)
    return out


def test_rest_and_places_by_walking_the_calendar(real, played):
    ends = collections.defaultdict(list)
    for g in played:
        ends[g.season].append(g.game_date)
    want = {}
    for (season, team), games in of_team(played).items():
        at = {g.game_date: (i, g) for i, g in enumerate(games)}
        today, stop = min(ends[season]), max(ends[season])
        rest, home, run, place, miles = 0, 1, 0, None, []
        while today <= stop:
            i, g = at.get(today, (None, None))
            now = home if g is None else g.is_home
            run = run + 1 if now == home else 1
            home = now
            if g is None:
                coming = next((x for x in games if x.game_date > today), None)
                city = team if coming is not None and coming.is_home else (place if place is not None else team)
                if coming is not None and not coming.is_home or coming is None:
                    known = [x for x in games if x.game_date < today]
                    city = team if not known else (team if known[-1].is_home else known[-1].opp)
                rest += 1
            else:
                city = team if g.is_home else g.opp
                far = 0 if place is None or place == city else abs(place - city) * 137 % 2500 + 50
                miles.append(far)
                stay = 1 if run > 30 else run
                want[g.game_id, team] = (rest, stay if home else 0, 0 if home else stay, far, round(sum(miles[-3:]) / len(miles[-3:])))
                rest = 0
            place = city
            today += datetime.timedelta(days=1)
    got = {(r.game_id, r.team): (r.rested_days, r.days_at_home, r.days_on_road, r.miles, int(r.distance_L3)) for r in real.windows.collect()}
    # A mean of miles that ends in one half may round either way.
    assert got.keys() == want.keys() and all(got[k][:4] == want[k][:4] and abs(got[k][4] - want[k][4]) <= 1 for k in want)


def test_standings_and_flags_by_brute_force(real, played):
    teams, season_games = collections.defaultdict(set), collections.defaultdict(set)
    for g in played:
        teams[g.season, g.conf].add(g.team)
        season_games[g.season].add(g.game_id)
    members = collections.defaultdict(set)
    for g in played:
        members[g.season].add(g.team)
    want = {}
    for (season, conf), mine in teams.items():
        length = 2 * len(season_games[season]) // len(members[season])
        for today in {g.game_date for g in played if g.season == season and g.conf == conf}:
            past = [g for g in played if g.season == season and g.team in mine and g.game_date < today]
            stat = {}
            for t in mine:
                own = [g for g in past if g.team == t]
                inside = [g for g in own if g.opp_conf == conf]
                wins = sum(g.win for g in own)
                stat[t] = (wins, len(own) - wins, sum(g.win for g in inside) / len(inside) if inside else 0.0, sum(g["diff"] for g in own), max(0, length - len(own)))
            beaten = collections.Counter((g.team, g.opp) for g in past if g.win and g.opp in mine)
            level = lambda t: sum(beaten[t, o] for o in mine if o != t and stat[o][:2] == stat[t][:2])
            order = sorted(mine, key=lambda t: (-stat[t][0], stat[t][1], -level(t), -stat[t][2], -stat[t][3], t))
            for k, t in enumerate(order):
                w, lost, *_, left = stat[t]
                cut = min(8 if int(season[:4]) < 2020 else 10, len(order))
                others = [o for o in order if o != t]
                clinched = sum(stat[o][0] + stat[o][4] >= w for o in others) < cut
                out = sum(stat[o][0] > w + left for o in others) >= cut
                locked = not any(stat[o][0] + stat[o][4] >= w for o in order[k + 1 :]) and not any(stat[o][0] <= w + left for o in order[:k])
                behind = ((stat[order[0]][0] - w) + (lost - stat[order[0]][1])) / 2
                want[season, today, t] = (w, lost, k + 1, behind, int(clinched), int(out), int(locked), int(out or locked))
    rows = real._played("s.wins, s.losses, s.conf_rank, s.games_behind_leader, s.clinched_playoff_berth, s.eliminated_from_playoffs, s.clinched_final_seed, s.indifference_flag").collect()
    assert rows and all(tuple(r)[4:] == want[r.season, r.game_date, r.team] for r in rows)


def test_wide_table_has_every_family_of_both_sides(spark):
    table = QUERIES["wide_features"](spark, SF)
    for c in ("sos_L82_HT", "gds_L41_VT_on_road", "norm_pts_diff_avg_L82_VT", "distance_L14_HT", "adjusted_last_season_record_HT_at_home", "indifference_flag_VT", "days_on_road", "neutral_court", "east_record_adjusted"):
        assert c in table.columns
    deltas = QUERIES["delta_features"](spark, SF)
    assert {"gds_L20_at_location_delta", "days_at_home_delta", "indifference_flag_delta", "conference_diff_home_advantage_pct"} <= set(deltas.columns)
    assert not [c for c in deltas.columns if c.endswith(("_HT", "_VT", "_on_road"))]
