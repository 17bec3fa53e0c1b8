"""Column mapping, coercion, readers, streaming ingestion and settings."""

import json

import pytest

from courtlake.functions import config
from courtlake.sources import games as g
from courtlake.sources import sinks
from courtlake.streaming import incremental


def test_mapping_rules():
    got = g.map_columns(["Game ID", "date", "home_pts", "awayScores", "colour", "gameLabel"])
    assert got == {"Game ID": "gameId", "date": "gameDate", "home_pts": "homeScore", "awayScores": "awayScore", "gameLabel": "gameLabel"}
    assert g.map_columns(["x", "y"], lambda _: {"x": "winner", "y": "nothing", "z": "gameId"}) == {"x": "winner"}


def test_normalise(spark):
    rows = [("1", "2025-01-02", "7", "8", "100", "90", None), ("2.0", "bad", "x", "8", "5", "5", ""), ("3", "2025-01-03", "7", "8", "90", "100", "7")]
    out = g.normalise(spark.createDataFrame(rows, "id string, date string, homeid string, awayid string, home_score string, away_score string, winner string")).collect()
    assert [r.gameId for r in out] == [1, 2, 3] and [r.winner for r in out] == [7, None, 7]
    assert out[1].gameDate is None and out[1].hometeamId is None and out[0].arenaId is None
    frame = g.normalise(spark.createDataFrame(rows, "id string, date string, homeid string, awayid string, home_score string, away_score string, winner string"))
    assert g.required_issues(frame) == {"gameDate": 1, "hometeamId": 1}
    assert g.with_required(frame).count() == 2


def test_synonyms_of_one_column_fill_each_other(spark):
    out = g.normalise(spark.createDataFrame([("1", None), (None, "2"), ("3", "4")], "id string, game_id string")).collect()
    assert [r.gameId for r in out] == [1, 2, 4]


def test_stream_ingestion(spark, tmp_path):
    drop, table, state = tmp_path / "drop", str(tmp_path / "games"), str(tmp_path / "state")
    drop.mkdir()
    (drop / "a.csv").write_text("id,date,homeid,awayid,home_score,away_score\n1,2025-01-01,1,2,100,90\n2,2025-01-01,3,4,80,90\n,2025-01-01,5,6,1,2\n")
    (drop / "b.csv").write_text("date,game_id,home_team_id,away_team_id,home_pts,away_pts\n2025-01-02,3,1,3,70,71\n2025-01-02,9,1,,70,71\n")
    (drop / "c.jsonl").write_text('{"id": 4, "date": "2025-01-03", "homeid": 2, "awayid": 1, "homepoints": 3, "awaypoints": 9}\n')
    (drop / "notes.txt").write_text("no games")
    seen = []
    run = lambda: incremental.ingest(spark, str(drop), table, state, refresh=lambda new, batch: seen.append((batch, new.count()))).awaitTermination()
    run()
    first = sorted((r.gameId or 0, r.winner) for r in incremental.read_table(spark, table).collect())
    assert first == [(0, 6), (1, 1), (2, 4), (3, 3), (4, 1)]
    run()
    assert seen == [(0, 5)]
    (drop / "d.json").write_text(json.dumps([{"id": 4, "date": "2025-01-03", "homeid": 2, "awayid": 1, "homepoints": 8, "awaypoints": 9}, {"id": 5, "date": "2024-12-30", "homeid": 2, "awayid": 1, "homepoints": 8, "awaypoints": 9}]))
    run()
    assert seen == [(0, 5), (1, 1)]
    incremental.ingest_batch(spark, [str(drop / "d.json")], 1, table)
    assert incremental.read_table(spark, table).count() == 6


def test_results_and_upsert(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"gameId": 1, "gameDate": "2025-01-01T19:00:00", "gameDateOnlyStr": "2025-01-01", "hometeamId": 1, "awayteamId": 2, "homeTeamFinalScore": 99, "awayTeamFinalScore": 98, "winner": 1, "postponed": 0}))
    (tmp_path / "2.json").write_text("{broken")
    good, bad = g.read_results(spark, str(tmp_path))
    row = good.collect()
    assert len(row) == 1 and row[0].homeScore == 99 and row[0].gameType == "" and row[0].arenaId is None
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["2.json"]
    old = good.withColumns({"homeScore": good.homeScore - 50})
    assert [r.homeScore for r in sinks.upsert_latest(old, good).collect()] == [99]


def test_readers_reject(spark, tmp_path):
    with pytest.raises(ValueError):
        g.read_games(spark, ["x"], "xml")
    (tmp_path / "1.json").write_text('{"gameId": 1}')
    with pytest.raises(ValueError):
        g.read_upcoming(spark, str(tmp_path))
    with pytest.raises(ValueError):
        g.features_and_target(spark.range(1), "y")


def test_settings(tmp_path):
    base, over = {"a": {"x": 1, "l": [1, 2]}, "b": 1}, {"a": {"l": [3]}}
    assert config.merge(base, over) == {"a": {"x": 1, "l": [3]}, "b": 1} and base["a"]["l"] == [1, 2]
    (tmp_path / "base.yaml").write_text("a: {x: 1, l: [1]}\nb: 2\n")
    (tmp_path / "top.yaml").write_text("_include: [base.yaml]\na: {l: [9]}\n")
    assert config.load(tmp_path / "top.yaml") == {"a": {"x": 1, "l": [9]}, "b": 2}
    (tmp_path / "loop.yaml").write_text("_include: [loop.yaml]\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "loop.yaml")
    moved = config.group_lags({"record_lags": [1], "location_lags": [5], "k": 0})
    assert moved == {"k": 0, "features": {"record": {"lags": [1], "location_lags": [5]}, "point_differential": {"location_lags": [5]}}}
    assert config.get(moved, "features.record.lags") == [1] and config.get(moved, "a.b", 3) == 3
    with pytest.raises(ValueError):
        config.require(moved, ["k", "nope"])
