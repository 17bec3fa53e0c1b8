"""Splits, models, calibration and feature selection; plans over ingested games."""

import math

import pytest
from pyspark.sql import functions as F

from courtlake.catalog import PLANS, QUERIES, run_plan
from courtlake.functions.dialect import SPARK
from courtlake.operators import models as m
from courtlake.operators import splits

SF = "/root/testdata/sf0.001"
KINDS = {"numeric": ["a", "b"], "flag": ["f"], "category": ["c"]}


@pytest.fixture(scope="module")
def table(spark):
    base = spark.range(400).withColumns({"a": F.rand(1), "b": F.rand(2), "f": F.rand(3) > 0.5, "day": F.col("id").cast("int") % 40})
    return base.withColumns({"y": (F.col("a") > 0.5).cast("int"), "c": F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)), "b": F.when(F.col("id") % 7 > 0, F.col("b"))}).cache()


def test_random_split_is_exact_and_repeats(table):
    rows = splits.random_split(table, "id", 0.2, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"test": 80, "val": 80, "train": 240}
    one, two = (splits.random_split(t, "id").select("id", "split").collect() for t in (table, table.repartition(7)))
    assert sorted(one) == sorted(two)


def test_stratified_split(table):
    got = {(r["c"], r["split"]): r["count"] for r in splits.random_split(table, "id", 0.25, 0.25, by=("c",)).groupBy("c", "split").count().collect()}
    for c, n in ((None, 134), ("k1", 133), ("k2", 133)):
        assert got[c, "test"] == got[c, "val"] == math.ceil(n / 4)


def test_folds_never_look_ahead(table):
    for train, val in splits.expanding_folds(table, "day", 3):
        assert train.agg(F.max("day")).first()[0] < val.agg(F.min("day")).first()[0]
        assert val.count() == 100


def test_train_predict_calibrate(spark, table, tmp_path):
    model = m.train(table, KINDS, m.learner("forest", numTrees=5, maxDepth=3))
    predicted = m.predict(model, table, KINDS)
    assert predicted.columns == [*table.columns, "y_proba", "y_pred"] and m.scores(predicted)["accuracy"] > 0.9
    m.save_model(spark, model, str(tmp_path / "m"), {"accuracy": 1})
    again, about = m.load_model(spark, str(tmp_path / "m"))
    assert about == {"accuracy": 1} and m.predict(again, table, KINDS).collect() == predicted.collect()
    flat = predicted.withColumn("y_proba", 0.4 + 0.2 * F.col("y_proba"))
    for method in ("sigmoid", "isotonic"):
        out, used = m.calibrate(flat, flat, method)
        assert used and m.scores(out)["brier"] < m.scores(flat)["brier"]
    best, means = m.tune(splits.expanding_folds(table, "day", 1), KINDS, "boosted", m.candidates({"maxIter": [1, 3], "maxDepth": [2]}))
    assert len(means) == 2 and best["maxDepth"] == 2
    assert m.routed_predictions([(model, "id < 10"), (model, "id >= 390")], table, KINDS).count() == 20


def test_feature_selection(table):
    full = table.na.fill(0.0, ["b"])
    assert m.select_features(full, "id", ["a", "b"], rounds=6, trees=5)["a"] == "confirmed"
    assert m.two_sided_binomial(3, 6) == 1 and m.two_sided_binomial(6, 6) == 2 / 64


def test_unknown_names():
    for call in (lambda: m.learner("svm"), lambda: m.preprocessing(KINDS, "none"), lambda: run_plan("season_of_date", None)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("name", ["record_rolling", "streak", "strength_of_schedule", "wide_features"])
def test_plans_over_ingested_games(spark, name):
    """Games written out in canonical columns give the rows that the order tables give."""
    g = QUERIES["games_view"](spark, SF)
    games = g.selectExpr("game_id gameId", "CAST(game_date AS TIMESTAMP) gameDate", "home hometeamId", "away awayteamId", "home_score homeScore", "away_score awayScore", "winner", "label gameLabel", "arena arenaId")
    teams = spark.read.parquet(f"{SF}/nation.parquet").selectExpr("n_nationkey teamId", "n_name teamName", "CASE WHEN n_regionkey % 2 = 0 THEN 'East' ELSE 'West' END Conference")
    got, want = run_plan(name, games, teams), spark.sql(PLANS[name](SPARK))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
