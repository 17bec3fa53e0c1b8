"""A family onto games, overtime columns, slugs, orders along asks, and readers of history and features."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from courtlake.operators import joins as j
from courtlake.sources import games as g


def test_a_family_onto_games(spark):
    games = spark.createDataFrame([(1, "s", 5, 6, 0.1), (2, "s", 6, 5, 0.2)], "gameId int, season string, hometeamId int, awayteamId int, old double")
    family = spark.createDataFrame([(1, "s", 5, 9.0, 1.0), (1, "s", 6, 8.0, 1.0), (2, "s", 6, 7.0, 1.0)], "gameId int, season string, teamId int, x double, old double")
    out = j.join_family(j.join_family(games, family, "hometeamId", "HT"), family, "awayteamId", "VT")
    assert out.columns == [*games.columns, "x_HT", "x_VT"] and [r[-2:] for r in out.orderBy("gameId").collect()] == [(9.0, 8.0), (7.0, None)]
    assert j.new_columns(games, family) == ["teamId", "x"]


def test_overtimes_and_slugs(spark):
    box = spark.createDataFrame([(1, "5", " ", "7"), (2, None, None, None)], ["id", "PTS_OT1", "PTS_OT2", "PTS_OT3"])
    assert [r.n for r in box.select(j.overtime_count(box).alias("n")).collect()] == [2, 0]
    assert box.select(j.overtime_count(box.select("id")).alias("n")).first().n == 0
    games = spark.createDataFrame([("A", "X", "B", "Y", "s", datetime.datetime(2025, 1, 2)), ("A", "X", "C", "Z", "s", datetime.datetime(2025, 1, 3))], "hometeamPrename string, hometeamName string, awayteamPrename string, awayteamName string, season string, gameDate timestamp")
    short = spark.createDataFrame([("A", "X", "s", "AX"), ("B", "Y", "s", "by"), ("B", "Y", "t", "no")], "city string, name string, season string, abbreviation string")
    assert sorted(r.slug or "" for r in j.with_slugs(games, short, "g").collect()) == ["", "g-by-ax-2025-01-02"]


def walk(p, asks, left, least=0.0):
    out = []
    for price, size in asks:
        if not 1 / price - 1 / p > least:
            break
        want = int(round((p - price) / price, 2) * left / price)
        if want <= size:
            out.append((price, want))
            break
        out.append((price, size))
        left -= size * price
    return out


@pytest.mark.parametrize("p", [0.3, 0.45, 0.6, 0.83])
def test_orders_equal_a_walk(spark, p):
    books = [[(0.31, 20.0), (0.37, 35.0), (0.52, 1000.0)], [(0.55, 4.0), (0.57, 6.0)], [(0.2, 3.0), (0.21, 1.0), (0.22, 1.0), (0.9, 5.0)], []]
    table = spark.createDataFrame([(i, p, [{"price": a, "size": s} for a, s in b]) for i, b in enumerate(books)], "id int, p double, asks array<struct<price:double,size:double>>")
    for budget, least in ((100.0, 0.0), (40.0, 0.3)):
        got = {r.id: [tuple(x) for x in r.o] for r in table.select("id", j.orders(F.col("p"), F.col("asks"), budget, least).alias("o")).collect()}
        assert got == {i: walk(p, b, budget, least) for i, b in enumerate(books)}


def test_readers_of_history_features_and_slates(spark, tmp_path):
    assert g.read_history(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "h.csv").write_text("id,date,homeid,awayid,home_score,away_score\n1,2025-01-01,1,2,100,90\n")
    assert [(r.gameId, r.winner) for r in g.read_history(spark, f"{tmp_path}/h.csv").collect()] == [(1, 1)]
    (tmp_path / "f.csv").write_text("a,flag,text\n1.5,True,x\n2.5,False,True\n")
    table = g.read_features(spark, f"{tmp_path}/f.csv", "csv")
    assert dict(table.dtypes) == {"a": "double", "flag": "boolean", "text": "string"}
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        g.read_features(spark, f"{tmp_path}/e.csv", "csv")
    (tmp_path / "slate").mkdir()
    for i in range(3):
        (tmp_path / "slate" / f"{i}.json").write_text(json.dumps({"gameId": i, "gameDate": "2025-01-01", "hometeamId": 1, "awayteamId": 2}))
    assert g.read_upcoming(spark, f"{tmp_path}/slate").count() == 3 and g.read_upcoming(spark, f"{tmp_path}/slate", 2).count() == 2
