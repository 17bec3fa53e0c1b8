"""Training from the wide table to a registered model: filters, deltas, splits, weights, selection, tuning, comparison, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.functions.scratch import cut
from courtlake.operators import models, splits
from courtlake.operators.deltas import Group, conference_features, create_deltas, create_momentum, filter_by_conference, resolve_features
from courtlake.operators.prediction import select_features
from courtlake.operators.registry import Registry, run_name
from courtlake.operators.validation import check_splits, check_table, check_target


@dataclass(frozen=True)
class Settings:
    """What an experiment is made of; the defaults are those of the reference's shared training settings."""

    groups: Mapping[str, Group]
    which: str = "all"
    min_season: str | None = "1980/81"
    min_games: int = 15
    min_games_test: int = 5
    test: float = 0.2
    val: float = 0.2
    saturation: float = 30.0
    decay: float = 0.1
    weighted: bool = True
    learners: Sequence[str] = ("forest", "boosted")
    params: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    grids: Mapping[str, Mapping[str, Sequence[Any]]] = field(default_factory=dict)
    tries: int = 20
    folds: int = 5
    metric: str = "accuracy"
    select: Mapping[str, Any] | None = None
    include_tentative: bool = True
    scaler: str = "standard"
    calibration: str | None = "sigmoid"
    decide_on: str = "test"
    momentum: Sequence[Any] = ()


def place_by_date(table: DataFrame, date: str, key: str) -> DataFrame:
    """Adds ``_place`` (from 1) and ``_rows`` along (date, key): ranks within a day, plus what the days before it hold."""
    days = table.groupBy(date).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(date)) - F.col("_n")  # a row per day
    days = days.select(date, before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(date).orderBy(key)))
    return ranked.join(days, date).withColumn("_place", F.col("_before") + F.col("_rank")).drop("_rank", "_before")


def with_split(table: DataFrame, date: str, key: str, test: float, val: float, holdout: DataFrame | None = None) -> DataFrame:
    """Adds ``split``: the last games by date to test, those before them to val, or a fixed holdout to test and the last of the rest to val."""
    if holdout is None:
        placed = place_by_date(table, date, key)
        n_test, n_val = F.floor(F.col("_rows") * test), F.floor(F.col("_rows") * val)
        split = F.when(F.col("_place") > F.col("_rows") - n_test, "test").when(F.col("_place") > F.col("_rows") - n_test - n_val, "val").otherwise("train")
        return placed.withColumn("split", split).drop("_place", "_rows")
    ids = holdout.select(key).distinct()
    held = table.join(ids, key, "left_semi").withColumn("split", F.lit("test"))
    rest = place_by_date(table.join(ids, key, "left_anti"), date, key)
    cut_at = F.col("_rows") - F.floor(F.col("_rows") * val)
    return rest.withColumn("split", F.when(F.col("_place") > cut_at, "val").otherwise("train")).drop("_place", "_rows").unionByName(held)


def with_weights(train: DataFrame, saturation: float, decay: float) -> DataFrame:
    """Adds ``weight``: how far into the season both teams are, times how late the season is among those trained on."""
    seasons = train.select("season").distinct()
    order = Window.orderBy("season")  # a row per season
    age = seasons.select("season", (F.count("*").over(Window.partitionBy()) - F.row_number().over(order)).alias("_age"))
    full = F.least(F.greatest(F.least("games_played_HT", "games_played_VT") / F.lit(float(saturation)), F.lit(0.0)), F.lit(1.0))
    return train.join(age, "season").withColumn("weight", full * F.exp(-F.lit(float(decay)) * F.col("_age"))).drop("_age")


def phase_accuracy(predicted: DataFrame, label: str = "y") -> DataFrame:
    """(phase, accuracy, n) by tens of games that the team with fewer has played, up to 82."""
    game = F.least("games_played_HT", "games_played_VT") + 1
    upper = F.when(game <= 80, F.ceil(game / 10) * 10).when(game <= 82, 82)
    scored = predicted.withColumn("phase", upper.cast("int")).filter("phase is not null")
    return scored.groupBy("phase").agg(F.avg((F.col(label) == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def baseline(table: DataFrame, delta: str) -> DataFrame:
    """The side with the better figure wins, the home team at par; a figure that is missing speaks for the visitor."""
    wins = F.coalesce(F.col(delta) >= 0, F.lit(False)).cast("int")
    return table.withColumns({"y_pred": wins, "y_proba": wins.cast("double")})


def prepare(wide: DataFrame, settings: Settings, target: str = "win", holdout: DataFrame | None = None, meta: Sequence[str] = ("season", "game_date", "games_played_HT", "games_played_VT")) -> tuple[dict[str, DataFrame], list[str]]:
    """({split: game_id, y, features, metadata, baselines}, features): the wide table through filters, deltas and splits."""
    if settings.which not in ("same", "different", "all"):
        raise ValueError(f"conference filter must be same, different or all, not {settings.which!r}")
    check_table(wide, ["game_id", "season", "game_date", target, "games_played_HT", "games_played_VT"])
    kept = wide if settings.min_season is None else wide.filter(F.col("season") >= settings.min_season)
    kept = filter_by_conference(kept, settings.which)
    named = kept.withColumns({"y": F.col(target).cast("int"), "_record": F.col("record_L82_HT") - F.col("record_L82_VT"), "_points": F.col("pts_diff_avg_L82_HT") - F.col("pts_diff_avg_L82_VT")} | {f"_{c}": F.col(c) for c in meta})
    named = cut(named)
    made = conference_features(create_momentum(create_deltas(named, settings.groups), settings.momentum), settings.which)
    features = select_features(made, settings.groups, settings.which, pairs=settings.momentum)[0].columns
    own = ["game_id", "y", "_record", "_points", *(f"_{c}" for c in meta)]
    table = made.select(*own, *[c for c in features if c not in own]).withColumnsRenamed({f"_{c}": c for c in meta if c not in features})
    # Cut before the null check: a check over so many differences makes Catalyst infer a constraint per subset of them.
    table = cut(table).na.drop(subset=features)
    divided = cut(with_split(table, "game_date", "game_id", settings.test, settings.val, holdout))
    out = {}
    for part in ("train", "val", "test"):
        least = settings.min_games_test if part == "test" else settings.min_games
        out[part] = divided.filter((F.col("split") == part) & (F.col("games_played_HT") > least) & (F.col("games_played_VT") > least)).drop("split")
    return out, features


def train_experiment(wide: DataFrame, settings: Settings, target: str = "win", holdout: DataFrame | None = None, registry: Registry | None = None, name: str = "games") -> dict[str, Any]:
    """Fits the learners, compares them and two baselines, calibrates the best and registers it.

    The best is that with the highest accuracy on ``decide_on``; ``val`` is the split that a fair comparison uses, and
    ``test`` the reference's.  Returns the best learner's name and model, all scores, the features, phases and predictions.
    """
    parts, features = prepare(wide, settings, target, holdout)
    sizes = {k: t.count() for k, t in parts.items()}
    check_splits(sizes)
    check_target(parts["train"], "y")
    verdict: dict[str, str] = {}
    if settings.select is not None:
        verdict = models.select_features(parts["train"], "game_id", features, **settings.select)
        wanted = ("confirmed", "tentative") if settings.include_tentative else ("confirmed",)
        features = [f for f in features if verdict[f] in wanted] or features
    kinds = models.feature_kinds(parts["train"].select(*features))
    train = with_weights(parts["train"], settings.saturation, settings.decay) if settings.weighted else parts["train"]
    scores: dict[str, dict[str, float]] = {}
    predicted: dict[str, dict[str, DataFrame]] = {}
    fitted: dict[str, PipelineModel] = {}
    tuned: dict[str, dict[str, Any]] = {}
    for kind in settings.learners:
        params = dict(settings.params.get(kind, {}))
        if settings.grids.get(kind):
            folds = splits.expanding_folds(parts["train"], "game_date", settings.folds)
            params |= models.tune(folds, kinds, kind, models.candidates(settings.grids[kind], settings.tries), settings.metric)[0]
        tuned[kind] = params
        fitted[kind] = models.train(train, kinds, models.learner(kind, weight="weight" if settings.weighted else None, **params), settings.scaler)
        predicted[kind] = {p: models.predict(fitted[kind], parts[p], kinds) for p in ("val", "test")}
        scores[kind] = models.scores(predicted[kind][settings.decide_on])
    for kind, delta in (("record_baseline", "_record"), ("points_baseline", "_points")):
        scores[kind] = models.scores(baseline(parts[settings.decide_on], delta))
    best = max(fitted, key=lambda k: scores[k]["accuracy"])
    held, better = predicted[best]["test"], False
    if settings.calibration:
        held, better = models.calibrate(predicted[best]["val"], held, settings.calibration)
    phases = phase_accuracy(held).join(phase_accuracy(baseline(parts["test"], "_record")).select("phase", F.col("accuracy").alias("accuracy_baseline")), "phase", "left")
    result = {"best": best, "model": fitted[best], "scores": scores, "features": features, "selection": verdict, "sizes": sizes, "params": tuned, "calibrated": better, "phases": phases, "predictions": held}
    if registry is not None:
        result["version"] = registry.save(f"{name}_{settings.which}", fitted[best], scores[best], features, kinds=kinds, learner=best)
        registry.log_run(run_name(name, best), {"which": settings.which, "learner": best, **tuned[best], **{f"n_{k}": n for k, n in sizes.items()}}, scores[best])
    return result


def expected_features(settings: Settings) -> list[str]:
    return resolve_features(settings.groups, settings.which, settings.momentum)
