"""Which stored measurements still describe the files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import specifiers
from ballast.operators import ranges
from ballast.session import pinned

# severity order of an entry's files
SEVERITY = ["fresh", "stale", "gone", "unknown"]


def _conflict(group):
    return group.agg(
        F.min("len").alias("_l0"),
        F.max("len").alias("_l1"),
        F.min("modified_millis").alias("_m0"),
        F.max("modified_millis").alias("_m1"),
        F.min("content_hash").alias("_h0"),
        F.max("content_hash").alias("_h1"),
    )


def stale_measurements(fingerprints: DataFrame, current: DataFrame, strict: bool = False) -> DataFrame:
    """Freshness of each fingerprint against the files as they are now.

    `current` has path, len, modified_millis, content_hash and `readable`; a
    missing path is gone. A fingerprint with `absent` true recorded that the file
    did not exist. With `strict`, first-party paths compare by content always.
    """
    now = current.select(
        "path",
        F.col("len").alias("_len"),
        F.col("modified_millis").alias("_millis"),
        F.col("content_hash").alias("_hash"),
        "readable",
    ).withColumn("_exists", F.lit(True))
    joined = fingerprints.join(now, "path", "left")
    exists = F.coalesce("_exists", F.lit(False))
    unreadable = exists & ~F.coalesce("readable", F.lit(True))
    same_stat = (F.col("len") == F.col("_len")) & (F.col("modified_millis") == F.col("_millis"))
    same_hash = F.col("content_hash") == F.col("_hash")
    by_content = F.lit(strict) & specifiers.is_first_party(F.col("path")) & F.col("content_hash").isNotNull()
    verdict = (
        F.when(F.col("absent"), F.when(~exists, "fresh").when(unreadable, "unknown").otherwise("stale"))
        .when(~exists, "gone")
        .when(unreadable, "unknown")
        .when(~by_content & same_stat, "fresh")
        .when(F.col("content_hash").isNull(), "stale")
        .when(same_hash, "fresh")
        .otherwise("stale")
    )
    return joined.withColumn("freshness", verdict).drop(
        "_len", "_millis", "_hash", "_exists", "readable"
    )


def worst_freshness(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown over gone over stale over fresh, per entry."""
    ranks = F.array(*[F.lit(name) for name in SEVERITY])
    worst = checked.groupBy(*keys).agg(
        F.max(F.array_position(ranks, F.col("freshness"))).alias("_rank")
    )
    return worst.select(*keys, F.element_at(ranks, F.col("_rank").cast("int")).alias("freshness"))


def conflicting_snapshots(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that saw one path in two states. Min and max per path combine
    before the shuffle; NULL hashes do not conflict."""
    per_path = _conflict(fingerprints.groupBy(*keys, "path"))
    differs = (
        (F.col("_l0") != F.col("_l1"))
        | (F.col("_m0") != F.col("_m1"))
        | F.coalesce(F.col("_h0") != F.col("_h1"), F.lit(False))
    )
    return per_path.groupBy(*keys).agg(F.bool_or(differs).alias("conflicting"))


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Fingerprints of several sources, each once."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined.distinct()


def measurement_worklist(installed: DataFrame, stored: DataFrame) -> DataFrame:
    """Measurements to make ahead of time: the namespace of each installed
    dependency, and its default export where the entry has one."""
    kinds = F.when(
        F.col("has_default"), F.array(F.lit("default"), F.lit("namespace"))
    ).otherwise(F.array(F.lit("namespace")))
    wanted = installed.select("workspace", "name", "version", F.explode(kinds).alias("import_kind")).distinct()
    return wanted.join(stored, ["workspace", "name", "version", "import_kind"], "left_anti")


def invalidate_packages(store: DataFrame, names: DataFrame) -> DataFrame:
    """The store without any row of the named packages."""
    return store.join(names.select("package_name").distinct(), "package_name", "left_anti")


def orphan_entries(store: DataFrame, live_paths: DataFrame, analyzer_version: str) -> DataFrame:
    """Rows of another analyzer version, or whose entry or root is gone.
    A NULL path is not gone."""
    return with_orphan(store, live_paths, analyzer_version).where("orphan").drop("orphan")


def with_orphan(store: DataFrame, live_paths: DataFrame, analyzer_version: str) -> DataFrame:
    """Add `orphan`, never NULL, to every row of the store.

    Many rows share a root, so roots are looked up once each and written out: their size is known, and
    where they are few no row of the store moves for them. Only rows that neither version nor root
    decides are joined by their entry.
    """
    roots = pinned(store.select("package_root").distinct())
    live_roots = pinned(
        live_paths.select(F.col("path").alias("package_root")).join(roots, "package_root", "left_semi").distinct()
    )
    rooted = store.join(live_roots.withColumn("_root", F.lit(True)), "package_root", "left")
    rootless = F.col("package_root").isNotNull() & F.col("_root").isNull()
    other = F.coalesce(F.col("analyzer_version") != analyzer_version, F.lit(False))
    marked = rooted.withColumn("orphan", other | rootless).select(*store.columns, "orphan")
    asked = ~F.col("orphan") & F.col("entry_path").isNotNull()
    entries = live_paths.select(F.col("path").alias("entry_path")).distinct().withColumn("_entry", F.lit(True))
    decided = (
        marked.where(asked).join(entries, "entry_path", "left").withColumn("orphan", F.col("_entry").isNull())
    )
    return marked.where(~asked).unionByName(decided.drop("_entry"))


def file_signature(imports: DataFrame, keys: list[str]) -> DataFrame:
    """H1: order-independent signature of a file's imports.

    The hash of each token is summed with wrap-around after equal tokens have
    been counted, so a file of any size needs one number and no collected array.
    """
    counted = imports.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_n"))
    mixed = F.xxhash64(F.col("token"), F.col("_n"))
    # halves are summed apart: 32-bit halves cannot overflow a 64-bit sum in practice
    low, high = mixed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mixed, 32)
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(low).alias("_low"), F.sum(high).alias("_high")
    ).select(*keys, F.xxhash64("tokens", "_low", "_high").alias("signature"), "tokens")


def revalidation_worklist(
    sites: DataFrame, freshness: DataFrame, keys: list[str], rechecked: DataFrame | None = None
) -> DataFrame:
    """One claim per stale key, document and generation; rows whose check is
    unknown are left out. `attempt` is 1, or 2 for the one claim more that a key gets where
    `rechecked` still says stale. Claims are counted once all sites have landed, so there is
    no state to bound and no order to keep."""
    stale = F.col("freshness").isin("stale", "gone")
    claims = sites.join(freshness.where(stale).select(*keys), keys)
    claims = claims.dropDuplicates([*keys, "workspace", "document", "generation"])
    first = claims.withColumn("attempt", F.lit(1))
    if rechecked is None:
        return first
    again = claims.join(rechecked.where(stale).select(*keys).distinct(), keys)
    return first.unionByName(again.withColumn("attempt", F.lit(2)))


def cache_outcomes(lookups: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, stale and unverified answers per request."""
    return lookups.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"),
        F.count_if(F.col("outcome") == "stale").alias("stale"),
        F.count_if(F.col("outcome") == "unverified").alias("unverified"),
    )


def unknown_graduation(checks: DataFrame, key: str, bucket_ms: int = 86_400_000) -> DataFrame:
    """T4 on a finished table: state of each `unknown` check by how long the run
    of consecutive unknown checks has lasted. Same rules as the stream."""
    bucket = F.floor(F.col("ts_ms") / bucket_ms)
    order = ["ts_ms", "seq"]
    paired = ranges.with_previous(checks, [key], order, bucket, ["outcome"])
    opens = (F.col("outcome") == "unknown") & (
        F.col("previous").isNull() | (F.col("previous")["outcome"] != "unknown")
    )
    started = paired.withColumn("_start", F.when(opens, F.struct("ts_ms", "seq"))).drop("previous")
    runs = ranges.carried_forward(started, [key], order, bucket, "_start", "_run").where(
        F.col("outcome") == "unknown"
    )
    # only attempts inside the quiet period can still be quiet; the rest need no rank
    nth = Window.partitionBy(key, "_run").orderBy(*order)
    early = (
        runs.where(F.col("ts_ms") - F.col("_run.ts_ms") < V.UNKNOWN_PERSIST_MS)
        .withColumn("_n", F.row_number().over(nth))
        .withColumn(
            "state",
            F.when(F.col("_n") <= V.UNKNOWN_MAX_ATTEMPTS, "stale_revalidating").otherwise("unverified"),
        )
        .drop("_n")
    )
    late = runs.where(F.col("ts_ms") - F.col("_run.ts_ms") >= V.UNKNOWN_PERSIST_MS).withColumn(
        "state", F.lit("unverified")
    )
    return early.unionByName(late).select(key, *order, "state")
