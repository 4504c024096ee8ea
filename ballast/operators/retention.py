"""Store size, recency and what to retire."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.operators import ranges
from ballast.session import pinned


def shard_rollup(store: DataFrame) -> DataFrame:
    """Bytes, rows and oldest sequence per shard."""
    return store.groupBy("shard_id").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("entry_count"),
        F.min("last_seq").alias("oldest_seq"),
    )


def store_rollup(store: DataFrame, budget_bytes: int) -> DataFrame:
    """The shards and one grand-total row (NULL shard) with its headroom."""
    shards = shard_rollup(store)
    total = shards.agg(
        F.lit(None).cast("string").alias("shard_id"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.coalesce(F.sum("entry_count"), F.lit(0)).alias("entry_count"),
        F.min("oldest_seq").alias("oldest_seq"),
        F.count(F.lit(1)).alias("project_count"),
    )
    headroom = F.greatest(F.lit(0), F.lit(budget_bytes) - F.col("size_bytes"))
    return (
        shards.withColumn("project_count", F.lit(1).cast("long"))
        .withColumn("headroom_bytes", F.lit(None).cast("long"))
        .unionByName(total.withColumn("headroom_bytes", headroom.cast("long")))
    )


def order_shards(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.col("size_bytes").desc(), F.col("shard_id").asc_nulls_first())


def recent_keys(store: DataFrame, n: int) -> DataFrame:
    """The n most recent rows of each shard; ties by key."""
    newest = Window.partitionBy("shard_id").orderBy(F.col("last_seq").desc(), F.col("key"))
    return store.withColumn("recency_rank", F.row_number().over(newest)).where(
        F.col("recency_rank") <= n
    )


def recency(events: DataFrame) -> DataFrame:
    """Last promoting access per key; bulk reads do not promote."""
    return events.groupBy("key").agg(
        F.max(F.when(F.col("intent") == "interactive", F.col("seq"))).alias("last_seq")
    )


def retention_plan(
    store: DataFrame,
    budget_bytes: int,
    floor_rows: int = V.RETENTION_FLOOR_ROWS,
    low_water: float = V.RETENTION_LOW_WATER,
) -> DataFrame:
    """Rows to evict so that the store falls to its low-water mark.

    Each shard keeps its newest `floor_rows`; beyond these the globally oldest
    rows go first. The protected rows come from a bounded top-n per shard, are
    written out so that their size is known, and are taken out by an anti join,
    so no shard is ranked in full and few protected rows move no others; the
    oldest rows are then cut by slice totals (`ranges.first_until`), which writes
    them: give a store no wider than needed. Exact to the row.
    """
    empty = store.limit(0)
    if budget_bytes == 0:
        return empty
    total = store.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if total <= budget_bytes:
        return empty
    needed = total - int(budget_bytes * low_water)
    protected = pinned(recent_keys(store, floor_rows).select("shard_id", "key"))
    evictable = store.join(protected, ["shard_id", "key"], "left_anti")
    oldest = [F.col("last_seq"), F.col("shard_id"), F.col("key")]
    return ranges.first_until(evictable, oldest, "size_bytes", needed)


def retention_outcome(store: DataFrame, evicted: DataFrame, budget_bytes: int) -> DataFrame:
    """Evicted rows and bytes, and whether the store is still over budget."""
    before = store.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")).withColumn("_one", F.lit(1))
    gone = evicted.agg(
        F.count(F.lit(1)).alias("evicted_keys"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("evicted_bytes"),
    ).withColumn("_one", F.lit(1))
    left = F.col("total_bytes") - F.col("evicted_bytes")
    over = F.lit(budget_bytes != 0) & (left > budget_bytes)
    return before.join(gone, "_one").select(
        "evicted_keys", "evicted_bytes", left.alias("left_bytes"), over.alias("still_over_budget")
    )
