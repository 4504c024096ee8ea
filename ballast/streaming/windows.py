"""Streams that built-in windows and aggregations express. Each also runs on a
finished table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import specifiers as S
from ballast.operators import ranges
from ballast.streaming import runner


def _is_config(path: Column) -> Column:
    return F.substring_index(S.slashed(path), "/", -1).rlike(r"^(?:ts|js)config(?:\.[^./\\]+)?\.json$")


def change_bursts(
    events: DataFrame,
    tie: str,
    gap_ms: int = V.BURST_GAP_MS,
    limit: int = V.BURST_LIMIT,
    bucket_ms: int = 3_600_000,
) -> DataFrame:
    """T2 on a table: bursts of changes closer than the gap, with the decision.

    A workspace with most of the events is cut into time buckets. Distinct paths
    are counted before any list is made, and only bursts of at most `limit`
    manifests get lists; configs are listed for those alone.
    """
    timed = events.where(F.length("path") > 0).withColumn("ts_ms", F.unix_millis("ts"))
    burst = ["workspace", "session_start"]
    grouped = ranges.sessions(timed, ["workspace"], "ts_ms", tie, gap_ms, bucket_ms)
    paths = grouped.select(*burst, "path").distinct()
    manifest = ~_is_config(F.col("path"))
    config = S.is_workspace_config(F.col("path"))
    counted = paths.groupBy(*burst).agg(
        F.count_if(manifest).alias("manifests"), F.count_if(config).alias("configs")
    )
    decided = counted.withColumn(
        "decision",
        F.when(F.col("manifests") > limit, "all")
        .when((F.col("manifests") == 0) & (F.col("configs") == 0), "none")
        .otherwise("changed"),
    ).where(F.col("decision") != "none")
    small = decided.where(F.col("decision") == "changed").select(*burst)
    lists = (
        paths.join(small, burst)
        .groupBy(*burst)
        .agg(
            F.array_sort(F.collect_set(F.when(manifest, F.col("path")))).alias("manifest_paths"),
            F.array_sort(F.collect_set(F.when(config, F.col("path")))).alias("config_paths"),
        )
    )
    return decided.join(lists, burst, "left")


def change_bursts_stream(
    events: DataFrame, gap_ms: int = V.BURST_GAP_MS, limit: int = V.BURST_LIMIT, delay: str = "1 second"
) -> DataFrame:
    """T2 on a stream: a burst is a session window and comes out once, when the watermark has passed its end.

    Open sessions are merged in the state as their rows come, in any order within `delay`, so
    nothing that has landed is read again. The state of an open burst is its distinct paths;
    closed bursts leave it. `events` has a column CLOCK (`runner.run_closed`).
    """
    path, clock = F.col("path"), F.col(runner.CLOCK)
    # a filter without the clock rows would be pushed below the watermark and stop it
    timed = events.withWatermark("ts", delay).where(clock | (F.length(path) > 0))
    found = timed.groupBy("workspace", F.session_window("ts", f"{gap_ms} milliseconds").alias("span")).agg(
        F.collect_set(F.when(~_is_config(path), path)).alias("manifest_set"),
        F.collect_set(F.when(S.is_workspace_config(path), path)).alias("config_set"),
        F.bool_or(clock).alias(runner.CLOCK),
    )
    manifests, configs = F.size("manifest_set").cast("long"), F.size("config_set").cast("long")
    decision = F.when(manifests > limit, "all").when((manifests == 0) & (configs == 0), "none").otherwise("changed")
    listed = decision == "changed"
    return found.where(~F.col(runner.CLOCK) & (decision != "none")).select(
        "workspace", F.unix_millis("span.start").alias("session_start"), manifests.alias("manifests"), configs.alias("configs"),
        decision.alias("decision"), F.when(listed, F.array_sort("manifest_set")).alias("manifest_paths"),
        F.when(listed, F.array_sort("config_set")).alias("config_paths"),
    )


def restart_loops(restarts: DataFrame, tie: str, window_ms: int = V.RESTART_WINDOW_MS) -> DataFrame:
    """T3 on a table: each restart with the count of its trailing window.

    Restarts are counted per millisecond first, so a bucket of one window's length holds at most
    one row a millisecond. A count is added at its time and taken away when the window has passed
    it; it may do both in its own bucket and the next, so the trailing count is the running sum
    inside one (workspace, bucket), and a busy workspace spreads over time.
    """
    timed = restarts.withColumn("ts_ms", F.unix_millis("ts"))
    series = timed.groupBy("workspace", "ts_ms").agg(F.count(F.lit(1)).alias("_n"))
    own = F.floor(F.col("ts_ms") / window_ms)
    # (time, change, whether rows of this time are counted here)
    steps = F.array(
        F.struct(own.alias("bucket"), F.col("ts_ms").alias("at"), F.col("_n").alias("change"), F.lit(True).alias("asked")),
        F.struct((own + 1).alias("bucket"), F.col("ts_ms").alias("at"), F.col("_n").alias("change"), F.lit(False).alias("asked")),
        F.struct((own + 1).alias("bucket"), (F.col("ts_ms") + window_ms + 1).alias("at"), (-F.col("_n")).alias("change"), F.lit(False).alias("asked")),
    )
    so_far = (
        Window.partitionBy("workspace", "_s.bucket").orderBy("_s.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        series.select("workspace", F.explode(steps).alias("_s"))
        .withColumn("recent", F.sum("_s.change").over(so_far))
        .where("_s.asked")
        .select(F.col("workspace").alias("_workspace"), F.col("_s.at").alias("_at"), "recent")
    )
    return (
        timed.join(counted, F.col("workspace").eqNullSafe(F.col("_workspace")) & (F.col("ts_ms") == F.col("_at")))
        .withColumn("degraded", F.col("recent") > V.RESTART_LIMIT)
        .select("workspace", tie, "ts_ms", "recent", "degraded")
    )


def restart_loops_stream(restarts: DataFrame, delay: str = "1 minute") -> DataFrame:
    """T3 on a stream: sliding windows with too many restarts."""
    counted = (
        restarts.withWatermark("ts", delay)
        .groupBy("workspace", F.window("ts", "10 minutes", "1 minute").alias("span"))
        .agg(F.count(F.lit(1)).alias("restarts"))
    )
    return counted.where(F.col("restarts") > V.RESTART_LIMIT).select(
        "workspace",
        F.unix_millis("span.start").alias("window_start_ms"),
        "restarts",
    )


def log_dedupe(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """T7 on a stream: the first line per key within the watermark."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def log_key(kind: Column, request: Column, specifier: Column, detail: Column) -> Column:
    """What makes two log lines the same."""
    tail = F.when(kind == "debug", F.lit(None)).otherwise(F.coalesce(detail, F.lit("")))
    return F.concat_ws(":", kind, request.cast("string"), specifier, tail)


def current_requests(requests: DataFrame) -> DataFrame:
    """The newest request of each document; older ones are superseded."""
    return requests.groupBy("workspace", "document").agg(
        F.max("request_id").alias("current_request"), F.count(F.lit(1)).alias("requests")
    )


def indexed_partials(partials: DataFrame) -> DataFrame:
    """What each manifest position shows once all rows are in.

    The last final message of a manifest replaces all its positions: rows before it, and so
    positions past its end, are gone. The first dependency seen at a position after that keeps
    it; rows of another name or section are ignored. What still loads at the end is unavailable.
    Rows: manifest_path, position, name, section, status, seq, message, final; the rows of a
    message share its number.
    """
    finals = partials.where("final").groupBy("manifest_path").agg(F.max("message").alias("_from"))
    current = partials.join(finals, "manifest_path", "left").where(
        F.col("_from").isNull() | (F.col("message") >= F.col("_from"))
    )
    keys = ["manifest_path", "position"]
    per_name = current.groupBy(*keys, "name", "section").agg(
        F.min("seq").alias("first_seq"), F.max_by("status", "seq").alias("status")
    )
    chosen = per_name.groupBy(*keys).agg(
        F.min_by(F.struct("name", "section", "status"), "first_seq").alias("_row")
    )
    status = F.col("_row.status")
    return chosen.select(
        *keys,
        F.col("_row.name").alias("name"),
        F.col("_row.section").alias("section"),
        F.when(status == "loading", "unavailable").otherwise(status).alias("status"),
    )


#: What a manifest's messages have said so far, by message, as `indexed_partials` needs it.
PARTIALS = (
    "manifest_path string, position long, name string, section string, message long, "
    "first_seq long, last_seq long, status string, final boolean"
)
_SAID = ["manifest_path", "position", "name", "section", "message"]


def compact_partials(rows: DataFrame) -> DataFrame:
    """Rows of one batch as PARTIALS."""
    return rows.groupBy(*_SAID).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("status", "seq").alias("status"),
        F.bool_or("final").alias("final"),
    )


def merge_partials(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Both as PARTIALS -> PARTIALS. What came before the last final message of a manifest is
    dropped for good, so the table holds a manifest's present messages and not its past."""
    merged = stored.unionByName(batch).groupBy(*_SAID).agg(
        F.min("first_seq").alias("first_seq"), F.max_by("status", "last_seq").alias("status"),
        F.max("last_seq").alias("last_seq"), F.bool_or("final").alias("final"),
    )
    finals = merged.where("final").groupBy("manifest_path").agg(F.max("message").alias("_from"))
    current = merged.join(finals, "manifest_path", "left")
    return current.where(F.col("_from").isNull() | (F.col("message") >= F.col("_from"))).drop("_from")


def shown_partials(said: DataFrame) -> DataFrame:
    """What each position shows, from PARTIALS; the same rows as `indexed_partials` of all rows."""
    keys = ["manifest_path", "position"]
    per_name = said.groupBy(*keys, "name", "section").agg(
        F.min("first_seq").alias("first_seq"), F.max_by("status", "last_seq").alias("status")
    )
    chosen = per_name.groupBy(*keys).agg(F.min_by(F.struct("name", "section", "status"), "first_seq").alias("_row"))
    status = F.col("_row.status")
    return chosen.select(
        *keys, F.col("_row.name").alias("name"), F.col("_row.section").alias("section"),
        F.when(status == "loading", "unavailable").otherwise(status).alias("status"),
    )


def claims_stream(
    sites: DataFrame, freshness: DataFrame, keys: list[str], rechecked: DataFrame | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """T10 on a stream: sites joined to the checked keys, each claimed once.

    `freshness` and `rechecked` are tables of one row a key that every micro-batch reads anew,
    so a new version of them counts from the next batch on. The state is one row for each claim
    and expires with the watermark: a run continued from its checkpoint claims nothing twice, and
    a claim is forgotten once `delay` has passed. `sites` has the event time `ts`.
    """
    stale = F.col("freshness").isin("stale", "gone")
    open_ = sites.withWatermark("ts", delay).join(freshness.where(stale).select(*keys), keys)
    claimed = open_.dropDuplicatesWithinWatermark([*keys, "workspace", "document", "generation"]).drop("ts")
    if rechecked is None:
        return claimed.withColumn("attempt", F.lit(1))
    again = rechecked.where(stale).select(*keys, F.lit(2).alias("_again")).distinct()
    joined = claimed.join(again, keys, "left")
    return joined.withColumn("attempt", F.explode(F.array_compact(F.array(F.lit(1), "_again")))).drop("_again")
