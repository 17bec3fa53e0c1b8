"""Teams, schedules, raw games, validation, prompt sets, the settling of results, imputers, folds, the registry and a whole experiment."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from courtlake.catalog import league_of
from courtlake.operators import experiment as e
from courtlake.operators import models as m
from courtlake.operators import registry, splits
from courtlake.operators import validation as v
from courtlake.operators.deltas import DEFAULTS, Group
from courtlake.sources import sinks
from courtlake.sources import teams as t
from courtlake.streaming import incremental

RAW = "gameId string, gameDate string, hometeamCity string, hometeamId string, awayteamCity string, awayteamId string, homeScore string, awayScore string, winner string, gameType string, gameLabel string, gameSubLabel string"


def raw(spark, *rows):
    full = [(str(i), d, "LA", "1", "B", "2", h, a, "1", *(more or [None, None, None])) for i, d, h, a, *more in rows]
    return spark.createDataFrame([(*r[:9], *(r[9] if isinstance(r[9], (list, tuple)) else r[9:])) for r in full], RAW)


def test_raw_games(spark):
    table = raw(spark, (1, "2025-09-01 19:00:00", "90", "0"), (2, "2025-08-31", None, None), (3, "2025-01-05", None, "1"), (4, "2025-01-05", "5", "1"), (5, "no date", "5", "1"), (6, "2025-01-06", "0", None), (7, "2025-01-06", "90", "80"))
    got = {r.gameId: r for r in t.parse_raw_games(table).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 7]
    assert {i: r.postponed for i, r in got.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 6: 1, 7: 0}
    assert (got[1].season, got[2].season, got[1].hometeamPrename, got[1].gameDateOnlyStr, got[1].overtimes) == ("2025/26", "2024/25", "LA", "2025-09-01", 0)
    with pytest.raises(Exception, match="is no number"):
        t.parse_raw_games(raw(spark, ("x", "2025-01-01", "1", "2"))).collect()
    played, postponed = t.split_postponed(t.parse_raw_games(table))
    assert (played.count(), postponed.count()) == (3, 3)


def test_regular_season_and_neutral_courts(spark):
    rows = [
        (1, "2020/21", None, None, None), (2, "2020/21", "Playoffs", None, None), (t.CUP_FINAL, "2023/24", None, None, None), (4, "2023/24", None, "Preseason", "Championship"),
        (5, "2024/25", None, "Preseason", "Semifinals"), (6, "2024/25", None, None, "Championship"), (7, "2025/26", "Regular", "Preseason", None), (8, "2025/26", "Regular", "NBA Paris Game", "x"),
    ]
    games = spark.createDataFrame(rows, "gameId long, season string, gameType string, gameLabel string, gameSubLabel string")
    assert sorted(r.gameId for r in t.regular_season(games).collect()) == [1, 4, 5, 8]
    assert [r.gameId for r in t.with_neutral_flag(games).filter("is_neutral_court_game").collect()] == [8]
    assert "gameLabel" not in t.with_neutral_flag(games, drop=True).columns


def test_teams_by_season(spark, tmp_path):
    history = spark.createDataFrame(
        [(1, "A", "X", "AX ", "L", 2000, 2003, "East"), (1, "A2", "X", "AX", "L", 2002, 2100, "West"), (2, "B", "Y", "BY", "other", 2000, 2100, "East"), (3, "All-star", "Z", "Z", "L", 2000, 2100, "East"), (4, "D", "W", "D", "L", 2005, 2005, "East")],
        "teamId int, teamCity string, teamName string, teamAbbrev string, league string, seasonFounded int, seasonActiveTill int, Conference string",
    )
    seasons = t.expand_seasons(history, "L", 2004)
    assert [(r.teamId, r.season, r.Conference, r.teamAbbrev) for r in seasons.orderBy("season").collect()] == [
        (1, "2000/01", "East", "AX"), (1, "2001/02", "East", "AX"), (1, "2002/03", "East", "AX"), (1, "2003/04", "West", "AX"), (1, "2004/05", "West", "AX"),
    ]
    with pytest.raises(FileNotFoundError):
        t.read_teams(spark, f"{tmp_path}/none")
    seasons.write.parquet(f"{tmp_path}/teams")
    teams = t.read_teams(spark, f"{tmp_path}/teams")
    games = spark.createDataFrame([(9, "2003/04", 1, 7, 1), (8, "2000/01", 7, 1, None)], "gameId int, season string, hometeamId int, awayteamId int, winner int")
    got = {r.gameId: (r.hometeamConference, r.awayteamConference, r.winnerteamConference) for r in t.with_conferences(games, teams).collect()}
    assert got == {9: ("West", None, "West"), 8: (None, "East", None)}


def test_locations(spark):
    games = spark.createDataFrame([(1, 5, 6, "LA", "B"), (2, 6, 7, "B", "C")], "gameId int, hometeamId int, awayteamId int, hometeamPrename string, awayteamPrename string")
    places = spark.createDataFrame([(5, "Los Angeles", "California"), (6, "Town", None)], "teamId int, city string, state string")
    got = {r.gameId: r for r in t.with_locations(games, places).collect()}
    assert (got[1].hometeamPrename, got[1].hometeamLocation, got[1].awayteamLocation, got[1].gameLocation) == ("Los Angeles", "Los Angeles, California", None, "Los Angeles, California")
    whole = games.withColumns({"hometeamLocation": F.lit("kept"), "awayteamLocation": F.lit("kept"), "gameLocation": F.lit("kept")})
    assert {r.hometeamLocation for r in t.with_locations(whole, places).collect()} == {"kept"}
    holes = whole.withColumn("awayteamLocation", F.when(F.col("gameId") == 1, F.lit("kept")))
    assert {r.hometeamLocation for r in t.with_locations(holes, places).collect()} == {"Los Angeles, California", None}


def test_schedule_and_next_slate(spark, tmp_path):
    lines = ["gameId,gameDateTimeEst,homeTeamId,awayTeamId,gameLabel", "1,2025-01-01T19:00:00Z,1,2,", "2,2025-01-01T20:00:00Z,3,4,", "3,2025-01-03T01:00:00Z,1,3,", "4,2025-01-04T01:00:00Z,1,3,", "5,2025-01-02T01:00:00Z,0,3,", "6,2025-01-02T01:00:00Z,1,3,Preseason", "7,bad,1,3,"]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    schedule = t.read_schedule(spark, f"{tmp_path}/s.csv")
    assert sorted(r.gameId for r in schedule.collect()) == [1, 2, 3, 4, 7]
    assert schedule.filter("gameId = 3").first().gameDate == datetime.date(2025, 1, 3)
    spark.createDataFrame([(1, "2025-01-01 19:00:00")], "gameId long, gameDate string").write.parquet(f"{tmp_path}/played")
    played = t.read_played(spark, f"{tmp_path}/played")
    assert [r.gameId for r in t.next_slate(schedule, played).collect()] == [2]
    more = played.union(played.withColumn("gameId", F.lit(2).cast("long")))
    assert [r.gameId for r in t.next_slate(schedule, more).collect()] == [3]
    spark.createDataFrame([(1, "x")], "gameId long, gameDate string").write.parquet(f"{tmp_path}/undated")
    with pytest.raises(ValueError, match="no valid date"):
        t.read_played(spark, f"{tmp_path}/undated")


def test_validation(spark):
    table = spark.createDataFrame([(1, "a", 0, None), (2, "b", 1, 1.0), (3, "b", 1, None)], "id long, c string, y int, x double")
    assert v.check_table(table, ["id"], 3, {"id": "bigint", "absent": "int"}) == 3
    for wrong in (lambda: v.check_table(table, ["z"]), lambda: v.check_table(table, min_rows=4), lambda: v.check_table(table, kinds={"c": "int"}), lambda: v.check_table(table.limit(0))):
        with pytest.raises(ValueError):
            wrong()
    assert v.check_target(table, "y") == {0: 1, 1: 2}
    for wrong in (lambda: v.check_target(table, "y", 2), lambda: v.check_target(table.filter("y = 1"), "y"), lambda: v.check_features(table, numeric=["c"]), lambda: v.check_splits({"a": 0}), lambda: v.missing_summary(table, 0.5)):
        with pytest.raises(ValueError):
            wrong()
    assert v.missing_summary(table) == {"x": (2, 2 / 3)} and v.check_features(table, ["id"], ["c"])["category"] == ["c"]


def test_prompt_sets(spark, tmp_path):
    table = spark.createDataFrame([(i, f"text {i}" if i != 7 else None) for i in range(101)], "id long, prompt string").repartition(5)
    sets = sinks.prompt_sets(table, "prompt", "id")
    rows = sorted((r.id, r.split, r.text) for r in sets.collect())
    assert [s for _, s, _ in rows] == ["train"] * 80 + ["validation"] * 10 + ["test"] * 10 and rows[7] == (8, "train", "text 8")
    sinks.save_prompts(sets, f"{tmp_path}/prompts")
    assert spark.read.json(f"{tmp_path}/prompts").groupBy("split").count().count() == 3


def test_results_settle_games(spark, tmp_path):
    folder, results, state, archive = (tmp_path / x for x in ("upcoming", "results", "state", "archive"))
    folder.mkdir()
    for i in (1, 2):
        (folder / f"{i}.json").write_text(json.dumps({"gameId": i, "hometeamId": 5, "note": "x"}))
    known = [(1, 99, 90)]

    def lookup(games):
        table = spark.createDataFrame(known, "gameId long, homeTeamFinalScore int, awayTeamFinalScore int")
        return table.join(games.select(F.col("gameId").cast("long")), "gameId", "left_semi")

    run = lambda: incremental.settle(spark, str(folder), str(results), lookup, str(state), str(archive)).awaitTermination()
    run()
    done = lambda: sorted((r.gameId, r.homeTeamFinalScore, r.note) for r in spark.read.json(str(results)).collect())
    assert done() == [("1", 99, "x")]
    known.append((2, 80, 70))
    run()
    assert done() == [("1", 99, "x"), ("2", 80, "x")]


def test_imputers_outliers_and_folds(spark):
    table = spark.createDataFrame([(i, float(i) if i else None, "b" if i % 3 else "a") for i in range(101)] + [(200, None, None)], "id long, x double, c string")
    assert m.fill(table, ["x"]).filter("id = 200").first().x == 50.5 and m.fill(table, ["x"], "median").filter("id = 0").first().x == 50.5
    assert m.fill(table, ["c"], "mode").filter("id = 200").first().c == "b" and m.fill(table, ["x", "c"], "constant", 7).filter("id = 200").first()[1:] == (7.0, "7")
    ends = m.tame_outliers(table, ["x"]).agg(F.min("x"), F.max("x"), F.count("*")).first()
    assert (round(ends[0], 2), round(ends[1], 2), ends[2]) == (1.99, 99.01, 102)
    assert m.tame_outliers(table, ["x"], "remove").count() == 100
    with pytest.raises(ValueError):
        m.fill(table, ["x"], "guess")
    folds = splits.k_folds(table, "id", 4)
    seen = [r.id for _, val in folds for r in val.collect()]
    assert sorted(seen) == sorted(r.id for r in table.collect()) and all(a.count() + b.count() == 102 for a, b in folds)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    groups = {n: Group(enabled=False) for n in DEFAULTS} | {"record": Group((5,)), "norm_point_differential": Group((5, 13)), "rested_days": Group(), "indifference_flag": Group()}
    settings = e.Settings(groups, "all", None, 0, 0, learners=("single", "logistic"), params={"single": {"minInstancesPerNode": 5}}, grids={"single": {"maxDepth": [1, 2]}}, folds=2, select={"rounds": 2, "trees": 3, "depth": 2})
    store = registry.Registry(spark, str(tmp_path_factory.mktemp("store")))
    return settings, store, e.train_experiment(league_of(spark, "/root/testdata/sf0.001").wide(), settings, registry=store)


def test_an_experiment_from_the_wide_table(trained):
    settings, store, out = trained
    assert e.expected_features(settings) == ["record_L5_delta", "norm_pts_diff_avg_L5_delta", "norm_pts_diff_avg_L13_delta", "rested_days_delta", "indifference_flag_delta", "conference_diff_home_advantage_pct"]
    assert set(out["features"]) <= set(e.expected_features(settings)) and set(out["scores"]) == {"single", "logistic", "record_baseline", "points_baseline"}
    assert out["scores"][out["best"]]["accuracy"] == max(out["scores"][k]["accuracy"] for k in ("single", "logistic")) and out["params"]["single"]["maxDepth"] in (1, 2)
    held = out["predictions"].collect()
    assert len(held) == out["sizes"]["test"] and all(0 <= r.y_proba <= 1 for r in held)
    assert sum(r.n for r in out["phases"].collect()) == out["sizes"]["test"]


def test_registry_keeps_versions(spark, trained):
    _, store, out = trained
    assert out["version"] == 1 and store.names() == ["games_all"]
    assert store.save("games_all", out["model"], {"accuracy": 0.5}, ["f"], note="second") == 2 and store.versions("games_all") == [1, 2]
    assert store.load("games_all")[1]["note"] == "second" and store.load("games_all", 1)[1]["feature_names"] == out["features"]
    with pytest.raises(ValueError):
        store.load("nothing")
    run = store.runs().first()
    assert run.params["learner"] == out["best"] and run.metrics["accuracy"] == pytest.approx(out["scores"][out["best"]]["accuracy"])
    assert registry.run_name("same", "forest", datetime.datetime(2025, 1, 2, 3, 4, 5)) == "same-forest-20250102-030405"


def test_splits_and_weights(spark):
    days = [(i, datetime.date(2020 + i // 20, 1, 1 + i % 7), f"{2020 + i // 20}/x", i % 40, i % 35) for i in range(100)]
    table = spark.createDataFrame(days, "game_id long, game_date date, season string, games_played_HT int, games_played_VT int").repartition(7)
    order = [r.game_id for r in table.orderBy("game_date", "game_id").collect()]
    got = {r.game_id: r.split for r in e.with_split(table, "game_date", "game_id", 0.2, 0.1).collect()}
    assert [got[i] for i in order] == ["train"] * 70 + ["val"] * 10 + ["test"] * 20
    held = {r.game_id: r.split for r in e.with_split(table, "game_date", "game_id", 0.2, 0.25, table.filter("game_id < 8").select("game_id")).collect()}
    rest = [i for i in order if i >= 8]
    assert all(held[i] == "test" for i in range(8)) and [held[i] for i in rest] == ["train"] * 69 + ["val"] * 23
    weights = {r.game_id: r.weight for r in e.with_weights(table, 30, 0.1).collect()}
    assert weights[99] == pytest.approx(min(19, 29) / 30) and weights[15] == pytest.approx(15 / 30 * 2.718281828 ** (-0.4))
