"""Registry timing rules as column expressions. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast import vocabulary as V


def next_state(
    status: Column,
    too_large: Column,
    header_retry_ms: Column,
    attempt: Column,
    now_ms: Column,
    fetched: Column,
    cached: Column,
) -> Column:
    """The stored entry after one final response.

    `fetched` and `cached` are structs (latest_version, updated_at); `cached`
    may be NULL. A failure keeps what was cached and only moves `retry_after`.
    """
    kept_version = cached["latest_version"]
    kept_at = F.coalesce(cached["updated_at"], F.lit(0).cast("long"))
    none = F.lit(None)

    def entry(outcome, version, updated, retry, missing):
        return F.struct(
            F.lit(outcome).alias("outcome"),
            version.cast("string").alias("latest_version"),
            updated.cast("long").alias("updated_at"),
            retry.cast("long").alias("retry_after"),
            F.lit(missing).alias("not_found"),
        )

    wait = F.coalesce(header_retry_ms, attempt * V.REGISTRY_RETRY_STEP_MS)
    return (
        F.when(
            too_large,
            entry("oversize", kept_version, kept_at, now_ms + V.REGISTRY_NOT_FOUND_MS, False),
        )
        .when(status == 200, entry("fresh", fetched["latest_version"], now_ms, none, False))
        .when(status == 404, entry("not_found", none, now_ms, none, True))
        .when(status == 429, entry("rate_limited", kept_version, kept_at, now_ms + wait, False))
        .otherwise(
            entry("failed", kept_version, kept_at, now_ms + V.REGISTRY_TRANSIENT_RETRY_MS, False)
        )
    )


def is_transient_status(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def needs_refresh(
    mode: Column,
    has_entry: Column,
    has_metadata: Column,
    not_found: Column,
    updated_at: Column,
    retry_after: Column,
    cooling: Column,
    now_ms: Column,
) -> Column:
    """Whether a lookup must go to the registry."""
    age = F.greatest(now_ms - updated_at, F.lit(0))
    usable = F.when(has_metadata, age <= V.REGISTRY_FRESH_MS).otherwise(
        not_found & (age <= V.REGISTRY_NOT_FOUND_MS)
    )
    held = F.coalesce(retry_after > now_ms, F.lit(False))
    return (
        F.when(mode.isin("off", "cached"), False)
        .when(~has_entry, True)
        .when(mode == "refresh_stale", ~(usable | held))
        .otherwise(~cooling)
    )
