"""Names and values of the features that settings ask for, and the columns of games to come."""

import datetime

import pytest

from courtlake.operators import deltas as d
from courtlake.operators import prediction as p

OFF = d.Group(enabled=False)


def only(**groups):
    return {name: OFF for name in d.DEFAULTS} | groups


def test_names_of_one_group():
    assert d.resolve_features(only(record=d.Group(lags=(10, 82))), "same") == ["record_L10_delta", "record_L82_delta"]
    assert d.resolve_features(only(), "same") == []
    located = only(sos_adj_record=d.Group(lags=(13,), location_lags=(10, 41)))
    assert d.resolve_features(located, "same") == ["sos_adj_record_L13_delta", "sos_adj_record_L10_at_location_delta", "sos_adj_record_L41_at_location_delta"]
    assert d.resolve_features(only(sos=d.Group(lags=(5,), delta=False)), "same") == ["sos_L5_HT", "sos_L5_VT"]


def test_groups_do_not_lend_each_other_lags():
    groups = only(record=d.Group(lags=(1, 82)), sos_adj_record=d.Group(lags=(13, 55)), sos=d.Group(lags=(1, 3), enabled=False))
    assert d.resolve_features(groups, "same") == ["record_L1_delta", "record_L82_delta", "sos_adj_record_L13_delta", "sos_adj_record_L55_delta"]


def test_names_that_are_no_difference():
    assert d.resolve_features(only(home_and_road=d.Group(delta=False)), "same") == ["days_at_home", "days_on_road"]
    assert d.resolve_features(only(home_and_road=d.Group()), "same") == ["days_at_home_delta"]
    assert d.resolve_features(only(neutral_court=d.Group(delta=False)), "same") == ["neutral_court"]
    assert d.resolve_features(only(last_season_record=d.Group()), "same") == ["last_season_record_delta", "last_season_record_at_location_delta"]


def test_names_of_conferences_and_momentum():
    one = only(record=d.Group(lags=(5, 10)))
    assert d.resolve_features(one, "different")[2:] == ["home_conference_vs_away_conference_record", "games_played_at_home_conference"]
    assert d.resolve_features(one, "all")[2:] == ["conference_diff_home_advantage_pct"]
    assert d.resolve_features(one, "same", [d.Momentum("record", 5, 10)]) == ["record_momentum_L5_L10_delta"]


def test_settings_over_defaults():
    groups = d.feature_groups({"record": {"lags": [3], "extra": 1}, "gds": {"enabled": True}})
    assert groups["record"] == d.Group(lags=(3,)) and groups["gds"].enabled and not groups["sos"].delta and not groups["point_differential"].enabled


@pytest.fixture
def sides(spark):
    columns = {
        "record_L10_HT": [0.6, 0.5], "record_L10_VT": [0.4, 0.7], "record_L10_HT_at_home": [0.7, 0.55], "record_L10_VT_on_road": [0.3, 0.6], "indifference_flag_HT": [1, 0], "indifference_flag_VT": [0, 0],
        "days_at_home": [3, 1], "days_on_road": [2, 4], "streak_HT": [1, 2], "streak_VT": [0, 0], "neutral_court": [0, 1], "other": [7, 8],
    }
    return spark.createDataFrame(list(zip(*columns.values())), list(columns))


def test_deltas_replace_their_sources(sides):
    groups = only(record=d.Group(lags=(10, 82), location_lags=(10,)), indifference_flag=d.Group(), home_and_road=d.Group())
    out = d.create_deltas(sides, groups)
    assert out.columns == ["other", "record_L10_delta", "record_L10_at_location_delta", "indifference_flag_delta", "days_at_home_delta"]
    got = out.collect()
    assert [r.record_L10_delta for r in got] == pytest.approx([0.2, -0.2]) and [r.record_L10_at_location_delta for r in got] == pytest.approx([0.4, -0.05])
    assert [r.indifference_flag_delta for r in got] == [-1, 0] and [r.days_at_home_delta for r in got] == [5, 5]
    kept = d.create_deltas(sides, only(record=d.Group(lags=(10,), delta=False), home_and_road=d.Group(delta=False), neutral_court=d.Group(delta=False)))
    assert kept.columns == ["record_L10_HT", "record_L10_VT", "record_L10_HT_at_home", "record_L10_VT_on_road", "days_at_home", "days_on_road", "neutral_court", "other"]


def test_momentum_and_conferences(spark):
    table = spark.createDataFrame(
        [("East", "West", 0.6, 0.4, 0.7, 0.2, 5, 6, 11, 0.5, 0.1), ("West", "East", 0.6, 0.4, 0.7, 0.2, 5, 6, 11, 0.5, 0.1), ("West", "West", 0.6, 0.4, 0.7, 0.2, 5, 6, 11, 0.5, 0.1), (None, "West", 0.6, 0.4, 0.7, 0.2, 5, 6, 11, 0.5, 0.1)],
        ["home_conf", "away_conf", *("east_record_adjusted west_record_adjusted east_record_at_east west_record_at_west games_played_at_east games_played_at_west games_played_east_vs_west".split()), "record_L1_delta", "record_L5_delta"],
    )
    moved = d.create_momentum(table, [d.Momentum("record", 1, 5)])
    assert moved.columns[-1] == "record_momentum_L1_L5_delta" and moved.first()[-1] == pytest.approx(0.4) and "record_L1_delta" not in moved.columns
    assert [r.conference_diff_home_advantage_pct for r in d.conference_features(table, "all").collect()] == [pytest.approx(0.2), pytest.approx(-0.2), 0, None]
    different = d.conference_features(table, "different").collect()
    assert [(r.home_conference_vs_away_conference_record, r.games_played_at_home_conference) for r in different] == [(0.7, 5), (0.2, 6), (0.2, 6), (0.2, 6)]
    assert set(d.CONFERENCE_SOURCES) & set(d.conference_features(table, "same").columns) == set()
    with pytest.raises(ValueError):
        d.conference_features(table, "neither")
    assert [d.filter_by_conference(table, w).count() for w in ("same", "different", "all")] == [1, 3, 4]


def test_placeholders_alignment_and_selection(spark, sides):
    slate = spark.createDataFrame([(1, datetime.datetime(2025, 10, 3, 19), 5, 6, "Hall")], "gameId long, gameDate timestamp, hometeamId long, awayteamId long, arenaName string")
    row = p.with_placeholders(slate).first()
    assert (row.season, row.gameDateOnlyStr, row.winner, row.homeScore, row.gameType, row.arenaId, row.postponed) == ("2025/26", "2025-10-03", 0, 0, "Regular Season", None, 0)
    assert "arenaName" not in row.asDict()
    aligned = p.align(sides, ["streak_VT", "absent", "other"], allow_missing=True)
    assert aligned.columns == ["streak_VT", "absent", "other"] and p.missing_values(aligned, aligned.columns) == {"absent": 2}
    with pytest.raises(ValueError):
        p.align(sides, ["absent"])
    made = d.create_deltas(sides, only(record=d.Group(lags=(10, 82))))
    features, lacking = p.select_features(made, only(record=d.Group(lags=(10, 82))), "same")
    assert features.columns == ["record_L10_delta"] and lacking == ["record_L82_delta"]
    assert "other" not in p.select_features(sides, only(), "same", "exclusion", ["other", "absent"])[0].columns


def p_none(x):
    return x is None or x != x


def test_a_slate_sees_history_only(spark):
    from courtlake.catalog import ALL_GROUPS, QUERIES, league_of

    sf = "/root/testdata/sf0.001"
    whole = league_of(spark, sf)
    games = whole.games.select("game_id", "game_date", "season", "season_start", "home", "away", "home_score", "away_score", "winner", "label", "arena")
    last = games.orderBy("game_date", "game_id").tail(1)[0].game_date
    slate = games.filter(games.game_date == last)
    blank = slate.withColumns({c: p.F.lit(0).cast("long") for c in ("home_score", "away_score", "winner")})
    got = p.slate_features(games.filter(games.game_date < last), blank, whole.teams, ALL_GROUPS, "all").toPandas().sort_values("game_id")
    want = QUERIES["delta_features"](spark, sf).join(slate.select("game_id"), "game_id").toPandas().sort_values("game_id")
    assert len(got) > 0
    for a, b in zip(got.to_dict("records"), want.to_dict("records")):
        # A season's first game has no league mean before it; the mean of the whole table, which stands in, has the blank scores.
        assert [(c, a[c], b[c]) for c in b if not c.startswith("norm_") and a[c] != b[c] and not (p_none(a[c]) and p_none(b[c]))] == []
