"""Order-dependent work without one giant partition.

`range_slices` splits a total order over many tasks and pins the split;
`first_until` and `running_before` need only per-slice totals besides;
`with_previous` and `carried_forward` cut a long series into time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.session import pinned

SLICE = "_slice"


def range_slices(frame: DataFrame, *order: Column) -> DataFrame:
    """Range-partition on a total order and tag each row with its slice number.

    Slice bounds come from a sample, so the tagged rows are written out: every
    later use sees the same split, also after an executor is lost.
    """
    return pinned(frame.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()))


def _slice_offsets(sliced: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Total per slice and the sum of all slices before it. One row per slice
    (and key), so the window below is bounded by the number of slices."""
    totals = sliced.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    scope = [F.col(key) for key in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*scope).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))


def first_until(frame: DataFrame, order: list[Column], value: str, needed: int) -> DataFrame:
    """Rows taken in `order` while the sum of `value` before them is below `needed`.

    Whole slices are decided from their totals; only the slice that holds the
    crossing is ordered row by row.
    """
    sliced = range_slices(frame, *order)
    cuts = F.broadcast(  # one row per slice
        _slice_offsets(sliced, F.col(value)).where(F.col("_offset") < needed)
    )
    reached = sliced.join(cuts, SLICE)
    whole = F.col("_offset") + F.col("_total") < needed
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        reached.where(~whole)
        .withColumn("_before", F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .where(F.col("_before") < needed)
        .drop("_before")
    )
    taken = reached.where(whole).unionByName(crossing)
    return taken.drop(SLICE, "_total", "_offset")


def at_ranks(frame: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """Exact order statistics: the value at each zero-based rank of each group.

    `ranks` has the keys, a `label` and a `rank`. Equal values are counted first,
    then slices without a wanted rank are skipped.
    """
    counted = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(key) for key in keys] + [F.col(value)]
    sliced = range_slices(counted, *order)
    offsets = _slice_offsets(sliced, F.col("_n"), *keys).join(ranks, keys)
    wanted = offsets.where(
        (F.col("rank") >= F.col("_offset")) & (F.col("rank") < F.col("_offset") + F.col("_total"))
    ).select(*keys, SLICE, "_offset", "label", "rank")
    inside = Window.partitionBy(*keys, SLICE, "label").orderBy(value)
    placed = sliced.join(wanted, [*keys, SLICE]).withColumn(
        "_end", F.col("_offset") + F.sum("_n").over(inside)
    )
    hit = (F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_n"))
    return placed.where(hit).select(*keys, "label", F.col(value).alias("value"))


def row_numbers(frame: DataFrame, keys: list[str], order: list[Column], out: str, kept: list[str] | None = None) -> DataFrame:
    """Number all rows of each group in `order`, from 1. `kept` names the columns wanted beside `out`; without it, all.

    Rows are cut into range slices and sorted there, so a row's place in its slice is known where it
    is written. A group's rows lie together in a slice: their place is shifted by its first row there
    and by its rows in the slices before, one row a group and slice. Rows move once, and a group of
    any size spreads over tasks.
    """
    wanted = frame.columns if kept is None else kept
    ranged = [*[F.col(key) for key in keys], *order]
    placed = frame.repartitionByRange(*ranged).sortWithinPartitions(*ranged).withColumn("_at", F.monotonically_increasing_id())
    sliced = pinned(placed.select(*dict.fromkeys([*keys, *wanted]), "_at")).withColumn(SLICE, F.shiftright("_at", 33))
    held = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    of_key = {key: f"_key{n}" for n, key in enumerate(keys)}
    # their size is known once pinned, so the rows move to them only if there are many groups
    shifts = pinned(held.select(*[F.col(key).alias(name) for key, name in of_key.items()], F.col(SLICE).alias("_of"), shift.alias("_shift")))
    same = F.col(SLICE) == F.col("_of")
    for key, name in of_key.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return sliced.join(shifts, same).select(*wanted, (F.col("_at") + F.col("_shift")).cast("int").alias(out))


def with_previous(
    frame: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str]
) -> DataFrame:
    """Add `previous`, a struct of `values` from the row before, per key.

    A series is cut into (key, bucket) pieces; only the last row of each piece
    travels to the next one, so a hot key is spread over its buckets. `bucket`
    must not decrease along `order`.
    """
    packed = F.struct(*[F.col(name) for name in values])
    pieces = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = (
        frame.withColumn("_bucket", bucket)
        .withColumn("_inside", F.lag(packed).over(pieces))
        .withColumn("_first", F.row_number().over(pieces) == 1)
    )
    lasts = (
        frame.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(packed, F.struct(*[F.col(name) for name in order])).alias("_last"))
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    carried = (
        lasts.withColumn("_carry", F.lag("_last").over(along))
        .where(F.col("_carry").isNotNull())
        .select(*keys, "_bucket", "_carry")
    )
    joined = inside.join(carried, [*keys, "_bucket"], "left")
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_inside"))
    return joined.withColumn("previous", previous).drop("_bucket", "_inside", "_first", "_carry")


def carried_forward(
    frame: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Add `out`: the largest non-NULL `value` up to and including each row, per
    key. For a value that only grows along the series this is the latest one."""
    pieces = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = frame.withColumn("_bucket", bucket).withColumn("_inside", F.max(value).over(pieces))
    tops = frame.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tops.withColumn("_carry", F.max("_top").over(earlier))
        .where(F.col("_carry").isNotNull())
        .select(*keys, "_bucket", "_carry")
    )
    joined = inside.join(carried, [*keys, "_bucket"], "left")
    return joined.withColumn(out, F.coalesce("_inside", "_carry")).drop("_bucket", "_inside", "_carry")


def sessions(
    frame: DataFrame, keys: list[str], ts_ms: str, tie: str, gap_ms: int, bucket_ms: int
) -> DataFrame:
    """Add `session_start`: rows closer than `gap_ms` to the one before share it."""
    bucket = F.floor(F.col(ts_ms) / bucket_ms)
    marked = with_previous(frame, keys, [ts_ms, tie], bucket, [ts_ms])
    before = F.col("previous")[ts_ms]
    opens = before.isNull() | (F.col(ts_ms) - before >= gap_ms)
    started = marked.withColumn("_opens", F.when(opens, F.col(ts_ms))).drop("previous")
    return carried_forward(started, keys, [ts_ms, tie], bucket, "_opens", "session_start").drop("_opens")
