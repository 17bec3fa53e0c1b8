"""Fitted models by name and version, and the log of runs.

A version is a folder ``<root>/<name>/<version>`` with the model and one JSON
row about it, and is listed once that row is written, after the model.  Nothing
is shared between versions, so writers of other names or versions do not meet.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.operators.models import load_model, save_model


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(hadoop) if f.isDirectory()) if system.exists(hadoop) else []


def run_name(settings: str = "default", model: str | None = None, at: datetime | None = None) -> str:
    """Settings, model and time of a run, such as ``same-forest-20250102-030405``."""
    return "-".join([settings, *([model] if model else []), *([at.strftime("%Y%m%d-%H%M%S")] if at else [])])


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        return _folders(self.spark, f"{self.root}/models")

    def versions(self, name: str) -> list[int]:
        """Versions of a model, oldest first, that were written whole."""
        done = [v for v in _folders(self.spark, f"{self.root}/models/{name}") if "about" in _folders(self.spark, f"{self.root}/models/{name}/{v}")]
        return [int(v) for v in done]

    def save(self, name: str, model: PipelineModel, metrics: Mapping[str, float], features: list[str], **about: Any) -> int:
        """The new version's number."""
        taken = [int(v) for v in _folders(self.spark, f"{self.root}/models/{name}")]
        version = max(taken, default=0) + 1
        entry = {"model_name": name, "version": version, "timestamp": datetime.now().strftime("%Y%m%d_%H%M%S"), "metrics": dict(metrics), "feature_names": features, **about}
        save_model(self.spark, model, f"{self.root}/models/{name}/{version:06d}", entry)
        return version

    def load(self, name: str, version: int | None = None) -> tuple[PipelineModel, dict[str, Any]]:
        """A version, or the latest one, and what was noted about it."""
        known = self.versions(name)
        if not known:
            raise ValueError(f"no model {name!r}")
        if version is not None and version not in known:
            raise ValueError(f"model {name!r} has no version {version}")
        return load_model(self.spark, f"{self.root}/models/{name}/{version or known[-1]:06d}")

    def log_run(self, run: str, params: Mapping[str, Any], metrics: Mapping[str, float], tags: Mapping[str, str] | None = None) -> None:
        """One JSON row per run, added to those that are there."""
        row = json.dumps({"run": run, "params": dict(params), "metrics": dict(metrics), "tags": dict(tags or {})}, sort_keys=True, default=str)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        """(run, params, metrics, tags) of all runs; params and tags as text, metrics as numbers."""
        schema = "run string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
        return self.spark.read.text(f"{self.root}/runs").select(F.from_json("value", schema).alias("r")).select("r.*")
