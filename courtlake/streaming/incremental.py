"""Ingest dropped game files as a stream of micro-batches.

The stream carries the files' paths only.  Each batch reads its files in one
pass per header, maps and checks them, leaves out games that an earlier batch
brought, and writes its games to ``batch=<id>``.  A batch that runs again
overwrites its own folder and compares with earlier batches alone, so a retry
changes nothing.  The drivers' memory holds the paths of one batch, whose
number ``max_files`` bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courtlake.sources.games import Suggest, normalise, read_games, with_required
from courtlake.sources.schema import GAME_COLUMNS

SUFFIXES = ("csv", "json", "jsonl")
TABLE_SCHEMA = ", ".join(f"{c} {kind}" for c, kind in GAME_COLUMNS.items()) + ", batch bigint"
#: Called with the games of a batch after they are written, to rebuild what depends on their seasons.
Refresh = Callable[[DataFrame, int], None]


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All games ingested so far; empty before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], TABLE_SCHEMA)
    return spark.read.schema(TABLE_SCHEMA).parquet(table)


def only_new(games: DataFrame, existing: DataFrame, key: str = "gameId") -> DataFrame:
    """Games whose key no earlier batch has; games without a key are kept.  Only the key column of the table is read."""
    return games.join(existing.select(key).filter(F.col(key).isNotNull()), key, "left_anti").select(*games.columns)


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, str], list[str]]:
    """The batch's paths by suffix and, for CSV, by their first line, which is all that is read of a file here."""
    groups: dict[tuple[str, str], list[str]] = {}
    for path in sorted(paths):  # at most max_files
        kind = path.rsplit(".", 1)[-1].lower()
        groups.setdefault((kind, _first_line(spark, path) if kind == "csv" else ""), []).append(path)
    return groups


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def ingest_batch(spark: SparkSession, paths: list[str], batch: int, table: str, key: str = "gameId", suggest: Suggest | None = None) -> DataFrame:
    """Write the new games of these files to the table's folder of the batch and return them."""
    groups = _by_header(spark, paths)
    frames = [normalise(read_games(spark, files, kind), suggest) for (kind, _), files in groups.items()]
    games = with_required(reduce(DataFrame.unionByName, frames))
    folder = f"{table}/batch={batch}"
    only_new(games, read_table(spark, table).filter(F.col("batch") < batch), key).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def ingest(
    spark: SparkSession, folder: str, table: str, checkpoint: str, archive: str | None = None, max_files: int = 1000,
    key: str = "gameId", suggest: Suggest | None = None, refresh: Refresh | None = None,
) -> StreamingQuery:
    """Take in what lies in the folder, oldest files first, then end.

    Files move to ``archive`` once a later batch is done, so the last ones
    stay until the next call; the checkpoint keeps them from being read twice.
    """
    reader = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.{csv,json,jsonl,CSV,JSON,JSONL}")
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def one(files: DataFrame, batch: int) -> None:
        paths = [r["path"] for r in files.select("path").collect()]
        if paths:
            games = ingest_batch(files.sparkSession, paths, batch, table, key, suggest)
            if refresh:
                refresh(games, batch)

    return reader.load(folder).select("path").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Called with the games that a batch of upcoming files holds; returns (gameId, and what is known of the game by now).
Results = Callable[[DataFrame], DataFrame]


def settle(spark: SparkSession, upcoming: str, results: str, lookup: Results, checkpoint: str, archive: str, max_files: int = 1000) -> StreamingQuery:
    """Take upcoming games (a JSON object per file) to ``results``, with what ``lookup`` knows of them, then end.

    A game goes on once its result is known; others are written back to ``upcoming``, as new files, for the next call.
    Files that were read move to ``archive`` once a later batch is done.  A batch that runs again writes the same folder,
    ``results/batch=<id>``, again.
    """
    schema = spark.read.option("multiLine", True).option("primitivesAsString", True).json(upcoming).schema
    reader = spark.readStream.schema(schema).option("multiLine", True).option("primitivesAsString", True).option("maxFilesPerTrigger", max_files)
    reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive).option("recursiveFileLookup", True)

    def one(games: DataFrame, batch: int) -> None:
        known = games.filter("gameId is not null").dropDuplicates(["gameId"])
        found = lookup(known)
        new = [c for c in found.columns if c != "gameId"]
        joined = known.drop(*new).join(found.withColumn("gameId", F.col("gameId").cast("string")), "gameId", "left")
        joined = joined.withColumn("_found", F.greatest(*[F.col(c).isNotNull() for c in new], F.lit(False)))
        joined.filter("_found").drop("_found").write.mode("overwrite").json(f"{results}/batch={batch}")
        waiting = joined.filter("not _found").select(*known.columns)
        if waiting.limit(1).count():
            waiting.repartition("gameId").write.mode("overwrite").json(f"{upcoming}/waiting-{batch}")

    return reader.json(upcoming).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
