"""Values a reader sees: byte counts, ages, dependency labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import quality as Q


def _tenths_text(tenths: Column) -> Column:
    whole = F.floor(tenths / 10).cast("long").cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))


def _kilo_tenths(size: Column) -> Column:
    """`size / 1000` in tenths, rounded on the exact value of the double quotient.

    A remainder of exactly 50 goes up only when the quotient, as a double, is not
    below the tie; the product error is recovered by splitting the quotient.
    """
    quotient = size / 1000
    high = quotient * 134217729 - (quotient * 134217729 - quotient)
    product = quotient * 1000
    error = (high * 1000 - product) + (quotient - high) * 1000
    not_below = ((product - size) + error) >= 0
    rest = size % 100
    up = (rest > 50) | ((rest == 50) & not_below)
    return F.floor((size - rest) / 100).cast("long") + F.when(up, 1).otherwise(0)


def format_bytes(size: Column) -> Column:
    """P25: `N B` below 1000, else `x.x kB`."""
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B"))).otherwise(
        F.concat(_tenths_text(_kilo_tenths(size)), F.lit(" kB"))
    )


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long").cast("string")


def format_cache_bytes(size: Column) -> Column:
    """P25: the 1024-based variant."""
    kilo, mega = size / 1024, size / (1024 * 1024)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kilo < 1024, F.concat(_whole(kilo), F.lit(" kB")))
        .when(mega < 1024, F.concat(_whole(mega), F.lit(" MB")))
        .otherwise(F.concat(_tenths_text(_whole(mega / 1024 * 10).cast("long")), F.lit(" GB")))
    )


def age_label(then_ms: Column, now_ms: Column) -> Column:
    """How long ago, in the largest whole unit."""
    delta = F.greatest(F.lit(0).cast("long"), now_ms - then_ms)

    def whole(unit: int) -> Column:
        return F.floor(delta / unit).cast("long")

    return (
        F.when(whole(86_400_000) >= 1, F.format_string("%dd ago", whole(86_400_000)))
        .when(whole(3_600_000) >= 1, F.format_string("%dh ago", whole(3_600_000)))
        .when(whole(60_000) >= 1, F.format_string("%dm ago", whole(60_000)))
        .otherwise("just now")
    )


def bytes_for_compression(mode: str, prefix: str = "") -> Column:
    """The size column a compression setting selects."""
    chosen = {"gzip": "gzip_bytes", "zstd": "zstd_bytes"}.get(mode, "brotli_bytes")
    return F.col(prefix + chosen)


def compression_label(mode: str) -> str:
    return {"gzip": "gz", "zstd": "zstd"}.get(mode, "br")


def version_suffix(status: Column, latest: Column, is_latest: Column, refresh: Column) -> Column:
    """The version status without the fresh-release mark."""
    stale = F.coalesce(refresh == "stale", F.lit(False))
    base = (
        F.when(status == "missing", F.concat(F.lit("install "), latest))
        .when(is_latest, "latest")
        .when(~is_latest, F.concat(F.lit("update "), latest))
    )
    known = F.when(
        stale,
        F.when(base.isNotNull(), F.concat(F.lit("stale · "), base)).otherwise("registry stale"),
    ).otherwise(base)
    return F.when(latest.isNull(), F.when(stale, "registry stale")).otherwise(known)


def version_status(
    status: Column, latest: Column, is_latest: Column, refresh: Column, published_ms: Column, now_ms: Column
) -> Column:
    """Marked when the latest release is younger than a day."""
    suffix = version_suffix(status, latest, is_latest, refresh)
    age = now_ms - published_ms
    fresh = F.coalesce(
        (status != "missing") & latest.isNotNull() & (age >= 0) & (age < V.FRESH_RELEASE_MS),
        F.lit(False),
    )
    return F.when(suffix.isNotNull() & fresh, F.concat(F.lit("✦ "), suffix)).otherwise(suffix)


def dependency_state(status: Column, diagnostics: Column) -> Column:
    """One categorical state per dependency."""
    return (
        F.when(status == "loading", "checking")
        .when(status == "missing", "not_installed")
        .when((status == "unavailable") | ~Q.is_measured(), "unavailable")
        .when(Q.is_types_only(diagnostics), "types_only")
        .when(Q.is_native_binary_only(diagnostics), "native_binary_only")
        .otherwise("measured")
    )
