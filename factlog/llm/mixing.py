"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: how strongly training draws on it at time t in [0, 1]. The area under the
schedule, scaled to the source's target, is its cumulative demand for words. A document lies at an offset of words in
its source's order; the time at which demand reaches that offset is its position, and documents are range-sorted by
position.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of size 0
takes nothing; repeated rows count as so many documents; an empty table gives an empty result; columns besides the id,
text and source are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, stored, text_of

#: Weights, dealt to the sources in turn.
WEIGHTS = (1.0, 2.0, 3.0)
#: For each weight the knots (t, intensity) of a piecewise linear schedule: light sources fade out, heavy ones come in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.2), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: A document is read so many times at most, and so is a source.
REPEATS = 3
#: Parts into which each source's order is cut, so that running sums never see a whole source.
PARTS = 4096


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the schedule has spent this share (0 to 1) of its area."""
    areas = [(b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, None
    for ((a, x), (b, y)), area in zip(zip(knots, knots[1:]), areas):
        rest = F.greatest(share * whole - before, F.lit(0.0))
        slope = (y - x) / (b - a)
        # x * s + slope / 2 * s^2 = rest, in the form that stays exact for a slope near 0
        t = F.least(a + 2 * rest / (x + F.sqrt(F.greatest(F.lit(x * x) + 2 * slope * rest, F.lit(1e-300)))), F.lit(b))
        out = t if out is None else F.when(share * whole < before, out).otherwise(t)
        before += area
    return out


def partial_time(knots: tuple[tuple[float, float], ...]):
    return lambda share: time_of(share, knots)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> with rank, weight, target: all words shared by weight, none above repeats times its size.

    Targets are min(repeats * size, level * weight). Sources are sorted by the level at which each is full; the level
    is that of the first source which the rest of the words doesn't fill. The windows see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (repeats * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level_here", left / heavy)
    fits = F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "rank", "level_here"))
    level = F.min(fits).over(everything)["level_here"]  # of the first source that is not full
    return ranked.withColumn("level", level).select(
        "source", "source_size", "rank", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def planned(sized: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """rid, id, source, part, hash, size -> with source_size, target, times, positions.

    Documents of a source are taken in the order of a hash of their id, whole epochs first; of the last, partial epoch
    those that lie within the target as a whole, and one more: that whose size comes nearest to what is then missing.
    """
    in_parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    by_part = Window.partitionBy("source").orderBy("part")
    starts = in_parts.withColumn("start", F.sum("part_size").over(by_part) - F.col("part_size"))
    wanted = targets(in_parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, repeats)
    starts = starts.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "start", "source_size", "target", "rank")

    rows = sized.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_s", "_p")
    running = Window.partitionBy("source", "part").orderBy("hash", "id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("offset", F.col("start") + F.sum("size").over(running) - F.col("size"))
    # where the source is full the division must not come out a hair below the number of repeats
    epochs = F.when(F.col("target") >= repeats * F.col("source_size"), F.lit(repeats)).otherwise(F.floor(F.col("target") / F.col("source_size")).cast("int"))
    rows = rows.withColumn("epochs", F.coalesce(epochs, F.lit(0)))
    rows = rows.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = stored(rows.withColumn("within", (F.col("size") > 0) & (F.col("offset") + F.col("size") <= F.col("rest"))), "mixing-rows")

    gap = rows.groupBy("rank").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("within"), F.col("size"))), F.lit(0))).alias("gap")).withColumnRenamed("rank", "_k")
    near = F.abs(F.col("size") - F.col("gap"))
    spare = rows.filter(~F.col("within") & (F.col("size") > 0) & (F.col("epochs") < repeats)).join(F.broadcast(gap), F.col("rank") == F.col("_k"))
    spare = spare.filter(near < F.col("gap")).groupBy("rank").agg(F.min(F.struct(near.alias("near"), F.col("offset"), F.col("rid"))).alias("best"))
    extra = spare.select(F.col("best.rid").alias("_rid"), F.lit(True).alias("extra"))
    rows = rows.join(F.broadcast(extra), F.col("rid") == F.col("_rid"), "left")  # as gap, one row for each source
    taken = F.col("epochs") + (F.col("within") | F.coalesce(F.col("extra"), F.lit(False))).cast("int")
    rows = rows.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(taken).cast("int"))
    positions = None
    for k, knots in enumerate(schedules):
        reads = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda j: j < F.col("times"))
        share = F.transform(reads, lambda j: F.least((j * F.col("source_size") + F.col("offset")) / F.col("target"), F.lit(1.0)))
        at = F.transform(share, partial_time(knots))
        positions = at if positions is None else F.when(F.col("rank") % len(schedules) == k, at).otherwise(positions)
    return rows.withColumn("positions", positions).select("rid", "id", "size", "source_size", "target", "times", "positions")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column, parts: int = PARTS) -> DataFrame:
    """Every row's size in words and its place in its source's order, in a table."""
    sized = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.col(id_col)).alias("hash"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), *more,
    )
    return stored(sized.withColumn("part", F.shiftrightunsigned("hash", 64 - (parts - 1).bit_length())), "mixing-sizes")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, times (how often it is read), positions (array of double), range-sorted by first position."""
    rows = planned(sizes(docs, id_col, text_col, source_col), **options).drop("rid")
    rows = rows.withColumn("_first", F.try_element_at("positions", F.lit(1)))
    return rows.repartitionByRange(F.col("_first").asc_nulls_last(), F.col("id")).sortWithinPartitions(F.col("_first").asc_nulls_last(), "id").drop("_first")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents in the order of training: each as often as the mix takes it, range-sorted by position."""
    sized = sizes(docs, id_col, text_col, source_col, packed(docs))
    rows = planned(sized.drop("_row"), **options).filter(F.col("times") > 0)
    rows = sized.select("rid", "_row").join(rows.select("rid", "id", "positions").hint("shuffle_hash"), "rid")
    rows = rows.select("_row", F.explode("positions").alias("_at"), "id").repartitionByRange("_at", "id").sortWithinPartitions("_at", "id")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
