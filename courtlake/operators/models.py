"""Preprocess, train, tune, calibrate and select features with ``pyspark.ml``.

Forests and boosted trees of ``pyspark.ml`` stand in for every tree learner;
gain importances stand in for SHAP values.  Both are substitutions: results
resemble those of other libraries but do not equal them.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.operators.splits import shuffled_rank

SCALERS = {
    "standard": lambda: StandardScaler(withMean=True, withStd=True),
    "robust": lambda: RobustScaler(withCentering=True, withScaling=True),
    "minmax": MinMaxScaler,
}


def feature_kinds(table: DataFrame, but: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns by kind: numeric, flag, category; others (dates, arrays) are left out."""
    kinds: dict[str, list[str]] = {"numeric": [], "flag": [], "category": []}
    for name, kind in table.dtypes:
        if name not in but:
            group = "flag" if kind == "boolean" else "category" if kind == "string" else "numeric" if kind.startswith(("decimal", "double", "float", "int", "bigint", "smallint", "tinyint")) else None
            if group:
                kinds[group].append(name)
    return kinds


def numbers(table: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Numeric features as doubles and flags as 0 and 1, which ``preprocessing`` expects."""
    return table.withColumns({c: F.col(c).cast("int").cast("double") if c in kinds["flag"] else F.col(c).cast("double") for c in (*kinds["numeric"], *kinds["flag"])})


def fill(table: DataFrame, columns: Sequence[str], strategy: str = "mean", constant: Any = None) -> DataFrame:
    """Nulls of these columns by their mean, median, mode (of any type, the smallest of equals) or a constant; all-null columns stay null."""
    if strategy == "constant":
        return table.withColumns({c: F.coalesce(F.col(c), F.lit(constant).cast(dict(table.dtypes)[c])) for c in columns})
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown strategy: {strategy}")
    how = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "mode": lambda c: F.mode(c, True)}[strategy]
    found = table.agg(*[how(F.col(c)).alias(c) for c in columns]).first() if columns else {}
    return table.withColumns({c: F.coalesce(F.col(c), F.lit(found[c])) for c in columns if found[c] is not None})


def tame_outliers(table: DataFrame, columns: Sequence[str], method: str = "clip", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond a column's percentiles become the percentile (``clip``), or their rows go (``remove``); nulls stay."""
    if method not in ("clip", "remove"):
        raise ValueError(f"unknown method: {method}")
    if not columns:
        return table
    ends = table.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(low), F.lit(high))).alias(c) for c in columns]).first()
    for c in columns:
        if ends[c] is not None:
            lo, hi = ends[c]
            if method == "clip":
                table = table.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))))
            else:
                table = table.filter(F.col(c).isNull() | F.col(c).between(lo, hi))
    return table


def importances(model: PipelineModel, kinds: Mapping[str, Sequence[str]]) -> list[tuple[str, float]]:
    """(feature, gain) of a fitted tree model, most important first; a category's places count together."""
    weights, out, at = model.stages[-1].featureImportances.toArray(), {}, 0
    for c in (*kinds["numeric"], *kinds["flag"]):
        out[c], at = float(weights[at]), at + 1
    if kinds["category"]:
        indexer = next(s for s in model.stages[0].stages if hasattr(s, "labelsArray"))
        for c, labels in zip(kinds["category"], indexer.labelsArray, strict=True):
            out[c], at = float(weights[at : at + len(labels)].sum()), at + len(labels)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def cross_validate(folds: Sequence[tuple[DataFrame, DataFrame]], kinds: Mapping[str, Sequence[str]], kind: str, label: str = "y", **params: Any) -> dict[str, tuple[float, float]]:
    """(mean, standard deviation) over the folds of accuracy, Brier score and log loss."""
    got = [scores(predict(train(t, kinds, learner(kind, label, **params)), v, kinds), label) for t, v in folds]
    mean = {m: sum(g[m] for g in got) / len(got) for m in got[0]}
    return {m: (x, math.sqrt(sum((g[m] - x) ** 2 for g in got) / len(got))) for m, x in mean.items()}


def preprocessing(kinds: Mapping[str, Sequence[str]], scaler: str = "standard", impute: str = "mean") -> Pipeline:
    """Impute and scale numbers, fill flags with their mode, one-hot categories (unseen ones and nulls get a place of their own)."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler: {scaler}")
    numeric, flags, texts = list(kinds["numeric"]), list(kinds["flag"]), list(kinds["category"])
    stages, parts = [], []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [Imputer(strategy=impute, inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_numeric")]
        stages.append(SCALERS[scaler]().setInputCol("_numeric").setOutputCol("_scaled"))
        parts.append("_scaled")
    if flags:
        filled = [f"{c}__filled" for c in flags]
        stages.append(Imputer(strategy="mode", inputCols=flags, outputCols=filled))
        parts += filled
    if texts:
        indexed, hot = [f"{c}__index" for c in texts], [f"{c}__hot" for c in texts]
        stages += [StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True)]
        parts += hot
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def learner(kind: str, label: str = "y", seed: int = 42, weight: str | None = None, **params: Any) -> Estimator:
    """``forest``, ``boosted`` or ``single`` trees, or ``logistic``; ``params`` are those of the ``pyspark.ml`` class."""
    if kind == "forest":
        out = RandomForestClassifier(labelCol=label, seed=seed, **({"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 15, "subsamplingRate": 0.7, "featureSubsetStrategy": "sqrt"} | params))
    elif kind == "boosted":
        out = GBTClassifier(labelCol=label, seed=seed, **({"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt"} | params))
    elif kind == "single":
        out = DecisionTreeClassifier(labelCol=label, seed=seed, **({"maxDepth": 5, "minInstancesPerNode": 15} | params))
    elif kind == "logistic":
        out = LogisticRegression(labelCol=label, **({"regParam": 0.01} | params))
    else:
        raise ValueError(f"unknown learner: {kind}")
    return out.setWeightCol(weight) if weight else out


def train(table: DataFrame, kinds: Mapping[str, Sequence[str]], estimator: Estimator, scaler: str = "standard") -> PipelineModel:
    return Pipeline(stages=[preprocessing(kinds, scaler), estimator]).fit(numbers(table, kinds))


def predict(model: PipelineModel, table: DataFrame, kinds: Mapping[str, Sequence[str]], threshold: float = 0.5) -> DataFrame:
    """The table's columns with ``y_proba`` and ``y_pred``."""
    scored = model.transform(numbers(table, kinds)).withColumn("y_proba", vector_to_array("probability")[1])
    return scored.select(*table.columns, "y_proba", (F.col("y_proba") >= threshold).cast("int").alias("y_pred"))


def routed_predictions(routes: Sequence[tuple[PipelineModel, str]], table: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each model predicts the rows of its condition; one union."""
    parts = [predict(model, table.filter(condition), kinds) for model, condition in routes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores(predicted: DataFrame, label: str = "y") -> dict[str, float]:
    """Accuracy, Brier score and log loss in one pass; probabilities are kept 1e-15 from 0 and 1."""
    y, p = F.col(label).cast("double"), F.col("y_proba")
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))
    row = predicted.agg(F.avg((y == F.col("y_pred")).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))
    return row.first().asDict()


def candidates(grid: Mapping[str, Sequence[Any]], tries: int | None = None, seed: int = 42) -> list[dict[str, Any]]:
    """All combinations, or ``tries`` of them drawn without repeats."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return every if tries is None or tries >= len(every) else random.Random(seed).sample(every, tries)


def tune(folds: Sequence[tuple[DataFrame, DataFrame]], kinds: Mapping[str, Sequence[str]], kind: str, params: Sequence[dict[str, Any]], metric: str = "log_loss", label: str = "y") -> tuple[dict[str, Any], list[float]]:
    """The parameters with the best mean score over the folds, first ones at ties, and every candidate's mean."""
    means = []
    for candidate in params:
        got = [scores(predict(train(t, kinds, learner(kind, label, **candidate)), v, kinds), label)[metric] for t, v in folds]
        means.append(sum(got) / len(got))
    best = max(means) if metric == "accuracy" else min(means)
    return params[means.index(best)], means


def calibrate(validation: DataFrame, held: DataFrame, method: str = "sigmoid", label: str = "y") -> tuple[DataFrame, bool]:
    """``held`` with probabilities calibrated on ``validation`` if that lowers their Brier score, else as it is."""
    vector = VectorAssembler(inputCols=["y_proba"], outputCol="_v")
    fit_on, apply_to = vector.transform(validation), vector.transform(held)
    if method == "sigmoid":
        moved = LogisticRegression(featuresCol="_v", labelCol=label, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(fit_on).transform(apply_to)
        value = vector_to_array("_p")[1]
    elif method == "isotonic":
        moved = IsotonicRegression(featuresCol="_v", labelCol=label, predictionCol="_p").fit(fit_on.withColumn(label, F.col(label).cast("double"))).transform(apply_to)
        value = F.col("_p")
    else:
        raise ValueError(f"unknown calibration: {method}")
    out = moved.withColumns({"y_proba": value, "y_pred": (value >= 0.5).cast("int")}).select(*held.columns)
    better = scores(out, label)["brier"] < scores(held, label)["brier"]
    return (out, True) if better else (held, False)


def two_sided_binomial(hits: int, n: int) -> float:
    """Probability, at even odds, of a count at least as unlikely as this one."""
    at = math.comb(n, hits)
    return min(1.0, sum(c for k in range(n + 1) if (c := math.comb(n, k)) <= at) / 2**n)


def select_features(table: DataFrame, key: str, names: Sequence[str], label: str = "y", rounds: int = 20, trees: int = 100, depth: int = 5, alpha: float = 0.05, seed: int = 42) -> dict[str, str]:
    """Each feature is ``confirmed``, ``tentative`` or ``rejected`` by whether it beats the best of the shadow features.

    A round's shadows are the features of another row, dealt by joining two
    seeded hash ranks, so they keep their own correlations but say nothing of
    the label.  A hit is an importance above every shadow's.
    """
    filled = Imputer(inputCols=list(names), outputCols=[f"{n}__filled" for n in names])
    doubles = table.select(key, label, *[F.col(n).cast("double").alias(n) for n in names])
    whole = filled.fit(doubles).transform(doubles).select(key, label, *[F.col(f"{n}__filled").alias(n) for n in names])
    mine = shuffled_rank(whole, key, seed).drop("_size").persist()  # every round passes over it
    inputs = [*names, *(f"shadow_{n}" for n in names)]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    hits = dict.fromkeys(names, 0)
    for r in range(rounds):
        other = shuffled_rank(mine.select(key, *names), key, seed + r + 1).select("_rank", *[F.col(n).alias(f"shadow_{n}") for n in names])
        dealt = assemble.transform(mine.join(other, "_rank")).select("features", label).persist()
        model = learner("forest", label, seed + r, numTrees=trees, maxDepth=depth).fit(dealt)
        dealt.unpersist()
        weight = dict(zip(inputs, model.featureImportances.toArray(), strict=True))
        bar = max(v for k, v in weight.items() if k.startswith("shadow_"))
        for name in names:
            hits[name] += int(weight[name] > bar)
    mine.unpersist()
    verdict = {}
    for name, h in hits.items():
        sure = two_sided_binomial(h, rounds) < alpha
        verdict[name] = "tentative" if not sure else "confirmed" if h > rounds / 2 else "rejected"
    return verdict


def save_model(spark: SparkSession, model: PipelineModel, path: str, about: Mapping[str, Any]) -> None:
    """The model beside one JSON row about it (scores, features, parameters)."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, Any]]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first()["value"])
