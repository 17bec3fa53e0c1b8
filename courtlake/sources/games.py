"""Readers of game feeds: map the columns, coerce the types, check what is required.

Everything after the schema lookup is one projection, so columns that no
canonical column draws on are never read from a columnar source.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.sources.schema import GAME_COLUMNS, REQUIRED, RESULT_COLUMNS, SYNONYMS

FUZZY_CUTOFF = 0.85
CORRUPT = "_corrupt"
#: May be asked for a mapping of what the names alone leave open: (source columns) -> {source: canonical}.
Suggest = Callable[[list[str]], dict[str, str]]


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def map_columns(columns: Iterable[str], suggest: Suggest | None = None) -> dict[str, str]:
    """Source column -> canonical column: by name, then by synonym, then by similarity of at least 0.85.

    Case, punctuation and spaces do not count.  ``suggest`` overrides the rules;
    targets that are not canonical are ignored.  Other columns are left out.
    """
    exact = {_plain(c): c for c in GAME_COLUMNS}
    synonyms = {_plain(s): c for c, names in SYNONYMS.items() for s in names}
    out = {}
    for column in columns:
        name = _plain(column)
        near = [exact[n] for n in difflib.get_close_matches(name, list(exact), 1, FUZZY_CUTOFF)]
        target = exact.get(name) or synonyms.get(name) or next(iter(near), None)
        if target:
            out[column] = target
    if suggest:
        known = set(columns)
        out |= {k: v for k, v in suggest(sorted(known)).items() if k in known and v in GAME_COLUMNS}
    return out


def coerce(column: Column, kind: str) -> Column:
    """Cast, or null where the value is not of the kind; whole numbers may be written with a fraction of zero."""
    if kind != "bigint":
        return column.try_cast(kind)
    number = column.try_cast("double")
    return F.coalesce(column.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))


def normalise(games: DataFrame, suggest: Suggest | None = None) -> DataFrame:
    """Canonical columns only, typed; absent ones are null, and a missing winner follows from the scores.

    Where several source columns mean the same, the first that is not null
    counts, exact names before others.  A tie leaves the winner null.
    """
    mapping = map_columns(games.columns, suggest)
    picked = []
    for target, kind in GAME_COLUMNS.items():
        sources = sorted((c for c, t in mapping.items() if t == target), key=lambda c: _plain(c) != _plain(target))
        values = [coerce(games[f"`{c}`"].cast("string"), kind) for c in sources]
        picked.append((F.coalesce(*values) if values else F.lit(None).cast(kind)).alias(target))
    home_won, away_won = F.col("homeScore") > F.col("awayScore"), F.col("homeScore") < F.col("awayScore")
    winner = F.coalesce("winner", F.when(home_won, F.col("hometeamId")).when(away_won, F.col("awayteamId")))
    return games.select(*picked).withColumn("winner", winner)


def required_issues(games: DataFrame) -> dict[str, int]:
    """Required columns with nulls (how many) or absent (-1), in one pass."""
    there = [c for c in REQUIRED if c in games.columns]
    nulls = games.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in there]).first().asDict() if there else {}
    return {c: nulls.get(c, -1) for c in REQUIRED if nulls.get(c, -1)}


def with_required(games: DataFrame) -> DataFrame:
    return games.na.drop(subset=list(REQUIRED))


def read_games(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """CSV with a header, JSON (an object or an array per file), JSON lines or Parquet; text stays text until ``normalise``."""
    if kind == "csv":
        return spark.read.option("header", True).csv(paths)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", kind == "json").option("primitivesAsString", True).json(paths)
    if kind == "parquet":
        return spark.read.parquet(*paths)
    raise ValueError(f"unsupported file type: {kind}")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results in canonical columns, files that are no JSON with the gameId as far as it was read): one object per file."""
    fields = ", ".join(f"{source} string" for _, source, _ in RESULT_COLUMNS)
    raw = (
        spark.read.schema(f"{fields}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("_file", F.col("_metadata.file_path"))
    )
    good = raw.filter(F.col(CORRUPT).isNull()).select(*[coerce(F.col(s), kind).alias(c) for c, s, kind in RESULT_COLUMNS])
    dated = F.when(F.col("gameDateOnlyStr") != "", F.col("gameDate"))
    constants = {"gameType": "''", "arenaId": "CAST(NULL AS BIGINT)", "gameLabel": "CAST(NULL AS STRING)", "gameSubLabel": "CAST(NULL AS STRING)", "seriesGameNumber": "CAST(NULL AS BIGINT)"}
    good = good.withColumns({"gameDate": dated} | {c: F.expr(e) for c, e in constants.items()})
    return good, raw.filter(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), "gameId")


def _listed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(time of change, path) of the files of a folder, oldest first; a file is itself; what is not there has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(hadoop) if system.exists(hadoop) else []
    return sorted((f.getModificationTime(), f.getPath().toString()) for f in found if f.isFile())


def read_history(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Games so far in the canonical columns; an empty table if nothing is there."""
    if not _listed(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in GAME_COLUMNS.items()))
    return normalise(read_games(spark, [path], kind))


def read_features(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A feature table; of a CSV, columns that hold nothing but True and False become flags.  An empty one is an error."""
    table = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(path)
    if not table.limit(1).count():
        raise ValueError(f"no rows in {path}")
    texts = [c for c, k in table.dtypes if k == "string"]
    if texts:
        flags = table.agg(*[F.every(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin("True", "False")).alias(c) for c in texts]).first().asDict()
        table = table.withColumns({c: F.col(f"`{c}`") == "True" for c in texts if flags[c]})
    return table


def read_upcoming(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Games to come, one JSON object per file, without those that lack an id, a team or a date; of the oldest ``max_files`` files."""
    paths = [path] if max_files is None else [p for _, p in _listed(spark, path)][:max_files]
    raw = read_games(spark, paths, "json")
    keys = ["gameId", "gameDate", "hometeamId", "awayteamId"]
    missing = [k for k in keys if k not in map_columns(raw.columns).values()]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return normalise(raw).na.drop(subset=keys)


def number_list(column: Column) -> Column:
    """A list of whole numbers that a CSV holds as text."""
    return F.from_json(column, "array<bigint>")


def features_and_target(table: DataFrame, target: str, features: list[str] | None = None, drop_na: bool = True) -> DataFrame:
    """Features and target, without rows that lack any of them."""
    names = features if features is not None else [c for c in table.columns if c != target]
    absent = [c for c in [*names, target] if c not in table.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    out = table.select(*names, target)
    return out.na.drop("any") if drop_na else out
