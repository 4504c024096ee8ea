"""Cost over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import labels
from ballast.functions import quality as Q
from ballast.operators import ranges

DAY_MS = 86_400_000


def _bucket(bucket_ms: int) -> Column:
    return F.floor(F.col("ts_ms") / bucket_ms)


def previous_measurement(
    current: DataFrame, history: DataFrame, keys: list[str], values: list[str], bucket_ms: int = DAY_MS
) -> DataFrame:
    """The latest earlier history row of each current row (as-of join).

    Both sides become one series; history rows carry their values forward. Rows
    are cut into (key, bucket) pieces so that a hot key spreads over its buckets.
    """
    none = [F.lit(None).cast(history.schema[name].dataType).alias(name) for name in values]
    past = history.select(*keys, "ts_ms", *values, F.lit(1).alias("_side"))
    now = current.select(*keys, "ts_ms", *none, F.lit(0).alias("_side")).distinct()
    packed = F.when(F.col("_side") == 1, F.struct("ts_ms", *values))
    series = past.unionByName(now).withColumn("_known", packed)
    # side 0 sorts before side 1 at one time, so only earlier rows are seen
    carried = ranges.carried_forward(
        series, keys, ["ts_ms", "_side"], _bucket(bucket_ms), "_known", "_latest"
    )
    answer = carried.where(F.col("_side") == 0).select(
        *keys, "ts_ms", *[F.col("_latest")[name].alias(f"previous_{name}") for name in ["ts_ms", *values]]
    )
    return current.join(answer, [*keys, "ts_ms"], "left")


def delta_label(current: Column, previous: Column, imprecise: Column, suffix: str = "") -> Column:
    """Signed change; an upper bound on either side is disclosed."""
    delta = current - previous
    sign = F.when(delta >= 0, "+").otherwise("-")
    label = F.concat(sign, labels.format_bytes(F.abs(delta)), F.lit(suffix))
    return F.when(imprecise, F.concat(label, F.lit(", against an upper bound"))).otherwise(label)


def history_delta(
    history: DataFrame, keys: list[str], tie: str, bucket_ms: int = DAY_MS
) -> DataFrame:
    """Each row against the one before it of the same file."""
    paired = ranges.with_previous(
        history, keys, ["ts_ms", tie], _bucket(bucket_ms), ["brotli_bytes", "imprecise"]
    )
    before = F.col("previous")
    return (
        paired.withColumn("previous_brotli_bytes", before["brotli_bytes"])
        .withColumn("delta_bytes", F.col("brotli_bytes") - before["brotli_bytes"])
        .withColumn(
            "delta_label",
            delta_label(
                F.col("brotli_bytes"),
                before["brotli_bytes"],
                F.col("imprecise") | before["imprecise"],
                " br vs previous",
            ),
        )
        .drop("previous")
    )


def history_changes(
    history: DataFrame, keys: list[str], tie: str, sizes: list[str], bucket_ms: int = DAY_MS
) -> DataFrame:
    """Rows whose sizes differ from the last recorded ones of the identity.

    An unchanged row records nothing, so the last recorded sizes are those of
    the row before.
    """
    paired = ranges.with_previous(history, keys, ["ts_ms", tie], _bucket(bucket_ms), sizes)
    same = F.lit(True)
    for size in sizes:
        same = same & F.col(size).eqNullSafe(F.col("previous")[size])
    return paired.where(F.col("previous").isNull() | ~same).drop("previous")


def latest_per_identity(changes: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The one kept row per identity; combined before the shuffle."""
    rest = [name for name in changes.columns if name not in keys]
    packed = F.struct(*[F.col(name) for name in rest])
    latest = changes.groupBy(*keys).agg(F.max_by(packed, F.struct("ts_ms", tie)).alias("_row"))
    return latest.select(*keys, "_row.*")


def history_cap(history: DataFrame, keys: list[str], tie: str, limit: int) -> DataFrame:
    """The newest rows of each store, at least one. The rank filter keeps
    `limit` rows per task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ts_ms").desc(), F.col(tie).desc())
    return (
        history.withColumn("age_rank", F.row_number().over(newest))
        .where(F.col("age_rank") <= max(1, limit))
    )


def durable_items(sites: DataFrame) -> DataFrame:
    """Rows an import history may take: ready, measured and durable."""
    return sites.where(
        (F.col("status") == "ready")
        & Q.is_measured()
        & Q.is_durable(F.col("diagnostics"), F.col("unmeasured_stage"))
    )


def history_series(
    history: DataFrame,
    tie: str,
    limit: int = V.FILE_HISTORY_ROWS,
    width: int = 960,
    height: int = 220,
    padding: int = 28,
) -> DataFrame:
    """Chart points of the capped history of each workspace.

    The cap comes first, so the windows below see at most `limit` rows each.
    """
    capped = history_cap(history, ["workspace"], tie, limit)
    whole = Window.partitionBy("workspace")
    newest_first = Window.partitionBy("workspace").orderBy("_first_rank")
    span = F.col("_newest") - F.col("_oldest")
    inner_w, inner_h = width - 2 * padding, height - 2 * padding
    x = F.when(span == 0, F.lit(inner_w / 2)).otherwise(
        (F.col("ts_ms") - F.col("_oldest")) / span * inner_w
    )
    return (
        capped.withColumn("_oldest", F.min("ts_ms").over(whole))
        .withColumn("_newest", F.max("ts_ms").over(whole))
        .withColumn("_peak", F.greatest(F.max("brotli_bytes").over(whole), F.lit(1)))
        .withColumn(
            "_first_rank", F.min("age_rank").over(Window.partitionBy("workspace", "file_name"))
        )
        .withColumn("series", F.dense_rank().over(newest_first))
        .withColumn("x", x + padding)
        .withColumn("y", F.lit(padding + inner_h) - F.col("brotli_bytes") / F.col("_peak") * inner_h)
        .drop("_oldest", "_newest", "_peak", "_first_rank")
    )


def file_summary(
    history: DataFrame, bucket_ms: int = DAY_MS, tie: str = "event_id"
) -> DataFrame:
    """Q6: the newest row of each file with its change against the row before."""
    deltas = history_delta(history, ["workspace", "file_name"], tie, bucket_ms)
    return latest_per_identity(deltas, ["workspace", "file_name"], tie)
