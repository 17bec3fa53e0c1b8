"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each source has a target number of words.  Among all document rates between 0
and ``most_copies`` those are chosen that meet the target and are closest, in
relative entropy, to taking half of what may be taken.  The convex dual has one
multiplier per source, and a document's rate is its exponential tilt
``most / (1 + exp(-multiplier * size / mean size))``.  Newton's steps, kept
inside a shrinking bracket, are grouped sums over the (source, size) histogram
of the corpus.  Rates are rounded into copies by running sums along the sizes
within hash ranges of a source, so rounding leaves a range at most one document
off; what that leaves of a source's target is added to or cut from its roomiest
documents, however many that takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm import common as c

SHARE, MOST, WEIGHTS = 1.5, 2, (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"
#: Hash ranges of a source in which rates are rounded: so many, and more where a range of all rows would exceed RANGE_ROWS.
_RANGES, RANGE_ROWS = 256, 1 << 19
#: A table with a row per source is broadcast up to so many sources.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _code_point_rank(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, by code point, a null source last.

    The sort deals ranges over the tasks; a source's place is its place in its range plus the sizes of the ranges
    before it, so however many sources there are, one task sees no more than a row per range.
    """
    keys = sources.select("source").orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    keys = c.materialise(keys.select("source", F.monotonically_increasing_id().alias("at")))
    ranges = keys.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("range").alias("r_range"), before.alias("r_before"))
    placed = keys.join(F.broadcast(ranges), F.shiftright("at", 33) == F.col("r_range"))  # a row per task of the sort
    return placed.select(F.col("source").alias("s"), (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("r_before")).alias("place"))


def _targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``totals`` (sid, source_size, ...) with ``target``: ``share`` of all sizes by weight, stopped at ``most`` times the source.

    The targets are ``min(most * size, level * weight)`` for the common level at which they sum to the share.  Newton's
    steps on that piecewise linear sum find it: every step is one grouped sum, stops the sources that the level lifts
    above their cap for good, and the steps end when none is left to stop.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    ranked = c.materialise(totals.withColumns({"weight": weight, "cap": F.col("source_size") * most}))
    goal = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= F.col("cap")
        at = ranked.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("cap"))).alias("stopped")).first()
        found = (goal - (at["stopped"] or 0)) / at["w"] if at["w"] else level
        if found is None or found == level or (level is not None and found < level):
            break
        level = found
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level or 0.0))
    return ranked.withColumn("target", F.greatest(target, F.lit(0.0))).drop("weight", "cap")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> target; sources take the weights in turn by code point, null last."""
    ids = c.materialise(_code_point_rank(sizes).select(F.col("s").alias("source"), F.col("place").alias("sid")))
    return _with_source(_targets(_with_source(sizes, ids).select("sid", "source_size"), weights, share, most), ids, "sid").select("source", "source_size", "target")


def _exact_sum(x: Column) -> Column:
    """Sum of whole millionths: the same in whatever order the rows come, so reruns agree to the last bit."""
    return (F.sum(F.round(x * 1e6).cast("decimal(28,0)")) / F.lit(1_000_000)).cast("double")


def _multipliers(histogram: DataFrame, targets: DataFrame, most: int, rounds: int = 40) -> DataFrame:
    """Newton on each source's dual; (sid, target, source_size, multiplier, mean, edge), edge -1 / 1 where all rates are 0 / ``most``."""
    state = c.materialise(
        targets.select(
            "sid",
            "target",
            "source_size",
            # A source without words has no mean; its target is 0, so its rates are.
            F.try_divide("source_size", "sized").alias("mean"),
            F.when(F.col("target") <= 0, -1).when(F.col("target") >= most * F.col("source_size"), 1).otherwise(0).alias("edge"),
            F.lit(0.0).alias("m"),
            F.lit(-700.0).alias("low"),
            F.lit(700.0).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        rate = F.lit(float(most)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("m") * z))))
        slope = rate * (1 - rate / most) * z
        sums = (
            histogram.join(state.filter("edge = 0 and not done").select("sid", "m", "mean"), "sid")
            .groupBy("sid")
            .agg(_exact_sum(F.col("n") * F.col("size") * rate).alias("f"), _exact_sum(F.col("n") * F.col("size") * slope).alias("df"))
        )
        over = F.col("f") - F.col("target")
        low, high = F.when(over < 0, F.col("m")).otherwise(F.col("low")), F.when(over > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.try_divide(over, F.col("df"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        near = F.abs(over) <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)
        stop = F.col("f").isNull() | near | F.col("done")
        moved = {"m": F.when(stop, F.col("m")).otherwise(step), "low": F.when(stop, F.col("low")).otherwise(low), "high": F.when(stop, F.col("high")).otherwise(high), "done": stop}
        state = c.materialise(state.join(sums, "sid", "left").withColumns(moved).drop("f", "df"))
        if not state.filter("edge = 0 and not done").limit(1).count():
            break
    return state.select("sid", "target", "source_size", F.col("m").alias("multiplier"), "mean", "edge")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
) -> DataFrame:
    """How much of each document a mix of the sources takes.

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target`` (its source's), ``rate``, ``copies`` (whole
    copies) and ``taken`` (words: copies * size, more or less for the documents
    that close what rounding leaves open, all but one of a source by whole
    copies, so that the source meets its target to the word); with ``key_col``
    also ``key``, that column, which decides nothing.

    * Null or empty text has size 0 and is never taken.  A source of size 0 has
      target 0.  A null source is a source of its own, the last.
    * Repeated rows are documents of their own.  Ties in size go by a hash of
      the row, and the same rows give the same mix at every run.
    * Empty input gives no rows; other columns are ignored.
    """
    sized = c.materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("tie"),
            *([F.col(key_col).alias("key")] if key_col else []),
        )
    )
    carried = ["key"] if key_col else []
    histogram = c.materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    # A source goes by its number from here on: joins on one number are the cheapest to broadcast.
    ids = c.materialise(_code_point_rank(histogram.groupBy("source").agg(F.lit(None))).select(F.col("s").alias("source"), F.col("place").alias("sid")))
    counted = c.materialise(_with_source(histogram, ids).select("sid", "size", "n"))
    totals = counted.groupBy("sid").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("sized")
    )
    goals = c.materialise(_targets(totals, weights, share, most))
    plan = c.materialise(_multipliers(counted.filter("size > 0"), goals, most))

    z = F.col("size") / F.col("mean")
    tilted = F.lit(float(most)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("multiplier") * z))))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("edge") < 0, 0.0).when(F.col("edge") > 0, float(most)).otherwise(tilted)
    rated = _with_source(_with_source(sized, ids), plan, "sid").withColumn("rate", rate)

    # Running sums along the sizes, in ranges of each source so that no source is one task.
    # Rates are summed as whole billionths, which add up alike in any order.
    ranges = max(_RANGES, (counted.agg(F.sum("n")).first()[0] or 0) // RANGE_ROWS)
    part = F.pmod(F.col("tie"), F.lit(ranges)).cast("int")
    unit = F.round(F.col("rate") * 1e9).cast("long")
    rated = rated.withColumn("part", part).withColumn("unit", unit)
    along = Window.partitionBy("sid", "part").orderBy(F.col("size").desc(), "tie", "doc_id")
    run = F.sum("unit").over(along.rowsBetween(Window.unboundedPreceding, 0))
    # Each range starts at its own phase, spread evenly, so that the ranges' errors cancel.
    phase = F.pmod(F.col("part").cast("long") * 618033989, F.lit(1_000_000_000))
    rounded = rated.withColumn("run", run + phase).withColumn(
        "copies",
        F.least(F.lit(most), F.expr("cast(run div 1000000000 - (run - unit) div 1000000000 as int)")),
    )
    rounded = rounded.select(*carried, "doc_id", "source", "sid", "size", "tie", "source_size", "target", "rate", "copies")
    rounded = c.materialise(rounded.withColumn("row", F.monotonically_increasing_id()))
    # What rounding left of a source is added to or cut from single documents, the roomiest first.
    got = rounded.groupBy("sid").agg(F.round(F.first("target")).cast("long").alias("goal"), F.sum(F.col("copies") * F.col("size")).alias("got"))
    asked = _with_source(rounded, c.materialise(got.select("sid", (F.col("goal") - F.col("got")).alias("gap"))), "sid")
    room = F.when(F.col("gap") > 0, most * F.col("size") - F.col("copies") * F.col("size")).otherwise(F.col("copies") * F.col("size"))
    roomy = asked.withColumn("room", room)
    fix = _closing(roomy.withColumn("source", F.col("sid")))
    closed = roomy.join(fix, F.col("row") == F.col("f_row"), "left")
    taken = F.col("copies") * F.col("size") + F.coalesce(F.col("f_change"), F.lit(0))
    return closed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken.cast("long").alias("taken"), *carried)


def _closing(roomy: DataFrame) -> DataFrame:
    """(row, change) of the documents that close a source's gap.

    The roomiest documents change by all their room until the gap is closed, however many that takes.  Level by level
    (room, ranges of hashes, hash and id, parts of the table, row) running sums over what a source has of each value
    find the one value at which the gap ends; rows before it change by all their room, and only its own rows go on to
    the next level.  So no source, room or repeated row is one task, and sums run over counts, not rows.
    """
    sign = F.signum("gap").cast("long")
    levels = {
        "room": -F.col("room"),
        "span": F.shiftright("tie", 52),
        "document": F.struct("tie", "doc_id"),
        "part": F.shiftright("row", 33),
        "row": F.col("row"),
    }
    at = roomy.filter("gap <> 0 and room > 0").select("source", "gap", "room", "tie", "doc_id", "row", F.abs("gap").alias("open"))
    closing = None
    for level in levels.values():
        at = at.withColumn("value", level)
        totals = at.groupBy("source", "open", "value").agg(F.sum("room").alias("total"))
        before = F.sum("total").over(Window.partitionBy("source").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
        left = F.col("open") - F.coalesce(before, F.lit(0))
        ends = totals.withColumn("left", left).filter("left > 0 and total >= left")
        ends = c.materialise(ends.select("source", F.col("value").alias("end"), "left"))
        joined = _with_source(at.withColumnRenamed("source", "sid"), ends.withColumnRenamed("source", "sid"), "sid").withColumnRenamed("sid", "source")
        whole = joined.filter("end is null or value < end").select("row", (F.col("room") * sign).alias("change"))
        closing = whole if closing is None else closing.unionByName(whole)
        at = c.materialise(joined.filter("value = end").withColumn("open", F.col("left")).drop("value", "end", "left"))
        if at.count() == ends.count():  # one row a source
            break
    # One row of a source is left, with at least as much room as is open.
    closing = closing.unionByName(at.select("row", (F.col("open") * sign).alias("change")))
    return closing.select(F.col("row").alias("f_row"), F.col("change").alias("f_change"))


def _with_source(rows: DataFrame, table: DataFrame, key: str = "source") -> DataFrame:
    """``rows`` with the columns of ``table``, a row per ``key`` at most, or nulls; null keys match.

    The table is broadcast while it is small, so that rows are not dealt by source; else the join is left to adaptive
    execution, which splits the hot sources.
    """
    named = table.withColumnRenamed(key, "t_key")
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    match = F.col(key) == F.col("t_key") if key == "sid" else F.col(key).eqNullSafe(F.col("t_key"))
    return rows.join(named, match, "left").drop("t_key")
