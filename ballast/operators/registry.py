"""Registry metadata: hints, merges, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import labels
from ballast.functions import quality as Q
from ballast.operators import ranges


def flatten_packuments(raw: DataFrame) -> DataFrame:
    """Latest version, publish time and sorted deprecated versions of each
    raw registry document; bad JSON gives no row."""
    versions = F.try_variant_get("_doc", "$.versions", "map<string,variant>")

    def text(value):
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    def field(path):
        return text(F.try_variant_get("_doc", path, "variant"))

    deprecated = F.filter(
        F.map_entries(versions),
        lambda entry: F.length(text(F.try_variant_get(entry["value"], "$.deprecated", "variant"))) > 0,
    )
    return (
        raw.withColumn("_doc", F.try_parse_json("body"))
        .where(F.col("_doc").isNotNull())
        .select(
            "name",
            field("$['dist-tags'].latest").alias("latest_version"),
            field("$.modified").alias("latest_published_at"),
            F.array_sort(
                F.coalesce(
                    F.transform(deprecated, lambda entry: entry["key"]),
                    F.array().cast("array<string>"),
                )
            ).alias("deprecated_versions"),
        )
    )


def registry_hints(dependencies: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join on the package name. Both verdicts are NULL when a side of
    the comparison is unknown."""
    known = registry.select(
        "name",
        "latest_version",
        "latest_published_at",
        "deprecated_versions",
        F.col("updated_at").alias("fetched_at"),
    ).withColumn("_hint", F.lit(True))
    joined = dependencies.join(known, "name", "left")
    installed = F.col("installed_version")
    deprecated = F.array_contains(
        F.coalesce("deprecated_versions", F.array().cast("array<string>")), installed
    )
    return (
        joined.withColumn("is_latest", installed == F.col("latest_version"))
        .withColumn("deprecated", F.when(F.col("_hint") & installed.isNotNull(), deprecated))
        .drop("_hint")
    )


def newer_hint(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the hint fetched later; on a tie the incoming one; NULL loses.

    Both sides have the keys and a nullable struct `hint` with `fetched_at`.
    """
    old, new = F.col("_old"), F.col("_new")
    joined = current.select(*keys, F.col("hint").alias("_old")).join(
        incoming.select(*keys, F.col("hint").alias("_new")), keys, "full"
    )
    zero = F.lit(0)
    keep_old = new.isNull() | (
        old.isNotNull() & (F.coalesce(old["fetched_at"], zero) > F.coalesce(new["fetched_at"], zero))
    )
    return joined.select(*keys, F.when(keep_old, old).otherwise(new).alias("hint"))


def union_merge(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """One entry per name, the newer wins, a tie keeps the in-memory one."""
    sided = disk.withColumn("_side", F.lit(0)).unionByName(memory.withColumn("_side", F.lit(1)))
    rest = [name for name in disk.columns if name != "name"]
    packed = F.struct(*[F.col(name) for name in rest])
    best = sided.groupBy("name").agg(F.max_by(packed, F.struct("updated_at", "_side")).alias("_row"))
    return best.select("name", "_row.*")


def entry_footprint():
    """Stored bytes of an entry, from its key and its JSON form."""
    fields = ["latest_version", "latest_published_at", "deprecated_versions", "updated_at",
              "retry_after", "error", "not_found"]
    value = F.octet_length(F.to_json(F.struct(*fields)))
    return (value + F.octet_length("name") + 4).cast("long")


def registry_retention(
    entries: DataFrame,
    now_ms: int,
    max_bytes: int = V.REGISTRY_MAX_BYTES,
    retention_ms: int = V.REGISTRY_RETENTION_MS,
) -> DataFrame:
    """Rows to drop, with the reason. Expired rows go first; then the oldest
    ones until what is left fits. `entries` has name, updated_at, size_bytes."""
    age = F.greatest(F.lit(now_ms) - F.col("updated_at"), F.lit(0))
    expired = entries.where(age > retention_ms).withColumn("reason", F.lit("expired"))
    live = entries.where(age <= retention_ms)
    if max_bytes == 0:
        return expired
    total = live.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if total <= max_bytes:
        return expired
    oldest = [F.col("updated_at"), F.col("name")]
    evicted = ranges.first_until(live, oldest, "size_bytes", total - max_bytes)
    return expired.unionByName(evicted.withColumn("reason", F.lit("over_budget")))


def section_summary(dependencies: DataFrame, mode: str = "brotli") -> DataFrame:
    """One line per manifest section."""
    measured = (F.col("status") == "ready") & Q.is_measured()
    rolled = dependencies.groupBy("workspace", "manifest_path", "section").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(measured).alias("measured"),
        F.coalesce(
            F.sum(F.when(measured, labels.bytes_for_compression(mode))), F.lit(0)
        ).alias("combined_bytes"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(
            (F.col("status") == "unavailable") | ((F.col("status") == "ready") & ~Q.is_measured())
        ).alias("unavailable"),
        F.count_if(F.col("status") == "loading").alias("loading"),
    )
    only_loading = (
        (F.col("measured") == 0)
        & (F.col("missing") == 0)
        & (F.col("unavailable") == 0)
        & (F.col("loading") > 0)
    )
    text = F.concat_ws(
        Q.DOT,
        F.format_string("%d/%d measured", "measured", "total"),
        F.concat(
            labels.format_bytes(F.col("combined_bytes")),
            F.lit(f" {labels.compression_label(mode)} combined"),
        ),
        F.when(F.col("missing") > 0, F.format_string("%d not installed", "missing")),
        F.when(F.col("unavailable") > 0, F.format_string("%d unavailable", "unavailable")),
    )
    return rolled.withColumn(
        "label",
        F.when(only_loading, F.format_string("%d checking...", "loading")).otherwise(text),
    )


def request_rate_violations(requests: DataFrame) -> DataFrame:
    """One-second windows with more requests than their kind may make.
    Works on a batch or on a stream with a watermark."""
    limit = F.when(F.col("manual"), V.REGISTRY_MANUAL_PER_SECOND).otherwise(
        V.REGISTRY_BACKGROUND_PER_SECOND
    )
    counted = requests.groupBy(F.window("ts", "1 second").alias("second"), "manual").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counted.where(F.col("requests") > limit).select(
        F.col("second.start").alias("window_start"), "manual", "requests"
    )


