"""Measurements per import site and cost per file."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import labels
from ballast.functions import quality as Q
from ballast.session import pinned, ship_package, spread

IDENTITY = ["specifier", "import_kind", "runtime", "names"]


def attach_measurements(sites: DataFrame, measurements: DataFrame) -> DataFrame:
    """Left join on identity with a status per site.

    `sites` carries `resolution` (installed / missing); both sides carry the
    identity columns, `names` being the sorted names as one string.
    """
    stored = measurements.withColumn("_stored", F.lit(True))
    joined = sites.join(stored, IDENTITY, "left")
    status = (
        F.when(F.col("resolution") == "missing", "missing")
        .when(F.col("_stored").isNull(), "loading")
        .when(F.col("unmeasured_stage") == "protocol", "unavailable")
        .otherwise("ready")
    )
    return joined.withColumn("status", status).drop("_stored")


def contributions(sites: DataFrame, identity: list[str]) -> DataFrame:
    """One row per module that a site pulls in."""
    return sites.select(*identity, F.explode("module_breakdown").alias("_m")).select(
        *identity, F.col("_m.path").alias("module_path"), F.col("_m.bytes").alias("bytes")
    )


def shared_bytes(parts: DataFrame, import_keys: list[str]) -> DataFrame:
    """Bytes of an import that another import of the same file and runtime
    also pulls in. Counts are combined before the shuffle and joined back, so a
    module used everywhere stays one counter."""
    scope = ["workspace", "source_file", "runtime", "module_path"]
    uses = parts.groupBy(*scope).agg(F.count(F.lit(1)).alias("_uses"))
    joined = parts.join(uses, scope)
    shared = F.when(F.col("_uses") > 1, F.col("bytes")).otherwise(F.lit(0).cast("long"))
    return joined.groupBy(*import_keys).agg(F.sum(shared).alias("shared_bytes"))


#: The scopes are told apart by so many buckets when one is looked for that holds too many rows.
_BUCKETS, _HOT_ROWS, _HOT_SHARE = 1024, 5_000_000, 32


def crowded(rows: DataFrame, keys: list[str], least: int = _HOT_ROWS) -> Column | None:
    """Which rows belong to key groups too large for one task; None where no group is.

    Rows are counted by hashed bucket of their group, so at most 1,024 numbers reach the driver.
    A bucket is crowded from `least` rows, and a 32nd of all, on.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    counts = {row[0]: row[1] for row in rows.groupBy(bucket.alias("_b")).count().collect()}
    most = max(least, sum(counts.values()) // _HOT_SHARE)
    hot = [n for n, count in counts.items() if count >= most]
    return bucket.isin(hot) if hot else None


def by_file(sites: DataFrame, identity: list[str], compute, spread_out, least: int = _HOT_ROWS) -> DataFrame:
    """What the modules of a file and runtime say together, from one shuffle of the sites.

    A site's modules travel inside its row, and `compute` groups them by keys that begin with file
    and runtime, so nothing moves again. Groups too large for one task go through `spread_out`,
    which shuffles single modules. Both take the exploded parts.
    """
    group = ["workspace", "source_file", "runtime"]
    needed = sites.select(*dict.fromkeys([*group, *identity]), "module_breakdown")
    hot = crowded(needed.select(*group), group, least)
    kept = needed if hot is None else needed.where(~hot)
    local = compute(contributions(kept.repartition(*group), [name for name in needed.columns if name != "module_breakdown"]))
    if hot is None:
        return local
    return local.unionByName(spread_out(contributions(needed.where(hot), [name for name in needed.columns if name != "module_breakdown"])))


def site_shared_bytes(sites: DataFrame, import_keys: list[str], least: int = _HOT_ROWS) -> DataFrame:
    """A6 from sites with their `module_breakdown`; the rows of `shared_bytes` over all contributions."""
    scope = Window.partitionBy("workspace", "source_file", "runtime", "module_path")

    def local(parts):
        used = parts.withColumn("_uses", F.count(F.lit(1)).over(scope))
        shared = F.when(F.col("_uses") > 1, F.col("bytes")).otherwise(F.lit(0).cast("long"))
        return used.groupBy(*import_keys).agg(F.sum(shared).alias("shared_bytes"))

    found = by_file(sites, import_keys, local, lambda parts: shared_bytes(parts, import_keys), least)
    if {"workspace", "source_file", "runtime"} <= set(import_keys):
        return found
    # an import may have sites in several files or runtimes
    return found.groupBy(*import_keys).agg(F.sum("shared_bytes").alias("shared_bytes"))


def top_modules(parts: DataFrame, import_keys: list[str], k: int = V.TOP_MODULES) -> DataFrame:
    """The largest modules of an import; ties by path. The rank filter lets
    Spark keep k rows per task before the shuffle."""
    by_size = Window.partitionBy(*import_keys).orderBy(F.col("bytes").desc(), F.col("module_path"))
    return parts.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= k)


def asset_breakdown(artifacts: DataFrame) -> DataFrame:
    """Five sizes per (file, asset kind).

    An artifact counts once per (file, runtime); each artifact is compressed on
    its own and the sizes are added.
    """
    once = artifacts.groupBy("workspace", "source_file", "runtime", "kind", "artifact_path").agg(
        *[F.max(size).alias(size) for size in V.SIZES]
    )
    return once.groupBy("workspace", "source_file", "kind").agg(
        *[F.sum(size).alias(size) for size in V.SIZES]
    )


def asset_totals(breakdown: DataFrame) -> DataFrame:
    """All kinds of a file together."""
    return breakdown.groupBy("workspace", "source_file").agg(
        *[F.sum(size).alias(size) for size in V.SIZES]
    )


def fallback_totals(sites: DataFrame, keys: list[str]) -> DataFrame:
    """A10: plain sums over measured imports, without deduplication. A missing or
    unmeasured import, or one with uncounted assets, leaves the total a floor."""
    measured = Q.is_measured()
    missing = ~measured | Q.has_uncounted(F.col("diagnostics"))
    return sites.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(measured, F.col(size))), F.lit(0)).alias(size) for size in V.SIZES],
        F.bool_or(measured).alias("sized_any"),
        F.bool_or(missing).alias("missing_inputs"),
    )


#: (part of a set, module) pairs that one task counts in memory, and module rows that every executor holds at a time.
_PAIRS_A_TASK, _ROWS_A_BLOCK = 2_000_000, 400_000


def _atoms(own: DataFrame) -> DataFrame:
    """Modules that the same packages hold, as one: _package, _module, _degree and the summed sizes.

    `own` has each module of a package once. A module whose size depends on the package stays by
    itself. Sets of packages are told apart by their number and two sums of 64-bit hashes, which
    combine before the shuffle.
    """
    alike = F.lit(True)
    for size in V.SIZES:
        alike = alike & F.min(size).eqNullSafe(F.max(size)) & F.count(size).isin(F.lit(0), F.count(F.lit(1)))
    owners = own.groupBy("module_path").agg(
        F.count(F.lit(1)).alias("_degree"),
        F.bit_xor(F.xxhash64("_package")).alias("_xor"),
        F.sum(F.xxhash64(F.lit(1), "_package").cast("decimal(20,0)")).alias("_sum"),
        alike.alias("_alike"),
    )
    kind = ["_degree", "_xor", "_sum", "_path"]
    named = owners.select("module_path", *kind[:3], F.when(~F.col("_alike"), F.col("module_path")).otherwise("").alias("_path"))
    ids = pinned(named.select(*kind).distinct().withColumn("_module", F.monotonically_increasing_id()))
    return own.join(named.join(ids, kind).select("module_path", "_degree", "_module"), "module_path").groupBy(
        "_package", "_module", "_degree"
    ).agg(*[F.sum(size).alias(size) for size in V.SIZES])


def _clustered(held: DataFrame, rounds: int = 2) -> DataFrame:
    """Adds `_cluster`, equal for modules that packages hold together.

    Modules held by about as many packages take the least label that reaches them over shared
    packages in a few rounds. Widespread modules are apart, as they would join everything. Sums are
    right for any clusters; good ones let few different parts of sets meet many modules.
    """
    links = pinned(held.select("_package", "_module", F.floor(F.log2("_degree")).alias("_level")))
    labels = links.select("_package", "_level").distinct().withColumn("_label", F.xxhash64("_package"))
    for _ in range(rounds):
        reached = links.join(labels, ["_package", "_level"]).groupBy("_module", "_level").agg(F.min("_label").alias("_label"))
        labels = links.join(reached, ["_module", "_level"]).groupBy("_package", "_level").agg(F.min("_label").alias("_label"))
    placed = links.join(labels, ["_package", "_level"]).groupBy("_module", "_level").agg(F.min("_label").alias("_label"))
    return held.drop("_degree").join(placed.select("_module", F.xxhash64("_level", "_label").alias("_cluster")), "_module")


def linked_by_packages(imports: DataFrame, weighed: DataFrame, group: list[str]) -> DataFrame:
    """What the packages of each group link, each module once: the five sizes summed.

    `imports` has the group and package_name; `weighed` has package_name, module_path and the sizes.
    Equal sets of packages are summed once. Modules with the same packages count as one, and modules are
    clustered by the packages that hold them: what a set links in a cluster depends only on its packages
    there, and these parts of sets recur far oftener than whole sets. Each part is summed once: the modules
    of a block come to the parts, and a task counts as many pairs of a part and a module as it can hold.
    The pairs are never written or shuffled.
    """
    spark = imports.sparkSession
    names = pinned(weighed.select("package_name").distinct().withColumn("_package", F.monotonically_increasing_id()))
    own = pinned(
        weighed.join(names, "package_name").groupBy("_package", "module_path").agg(*[F.max(size).alias(size) for size in V.SIZES])
    )
    held = pinned(_clustered(pinned(_atoms(own))))
    places = pinned(held.groupBy("_package", "_cluster").agg(F.count(F.lit(1)).alias("_n")))
    # a package without modules tells no two sets apart
    holding = imports.select(*group, "package_name").join(names, "package_name")
    grouped = pinned(holding.groupBy(*group).agg(F.array_sort(F.collect_set("_package")).alias("_packages")))
    whole = pinned(grouped.select("_packages").distinct().withColumn("_whole", F.monotonically_increasing_id()))
    split = pinned(
        whole.select("_whole", F.explode("_packages").alias("_package")).join(places, "_package")
        .groupBy("_whole", "_cluster").agg(F.array_sort(F.collect_set("_package")).alias("_part"), F.sum("_n").alias("_n"))
    )
    parts = pinned(
        split.groupBy("_cluster", "_part").agg(F.max("_n").alias("_n")).withColumn("_set", F.monotonically_increasing_id())
    )
    pairs = parts.agg(F.sum("_n")).first()[0] or 0
    blocks = -(-own.count() // _ROWS_A_BLOCK) or 1
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // (_PAIRS_A_TASK * blocks)))
    dealt = parts.repartition(tasks, "_set").select("_set", "_cluster", F.explode("_part").alias("_package"))
    summed = [
        pinned(
            # the groups stay where their set is, so neither grouping moves a row
            dealt.join(F.broadcast(held.where(F.pmod(F.xxhash64("_module"), F.lit(blocks)) == block)), ["_package", "_cluster"])
            .groupBy("_set", "_module").agg(*[F.max(size).alias(size) for size in V.SIZES])
            .groupBy("_set").agg(*[F.sum(size).alias(size) for size in V.SIZES])
        )
        for block in range(blocks)
    ]
    added = [F.sum(size).alias(size) for size in V.SIZES]
    by_part = parts.select("_cluster", "_part", "_set").join(reduce(DataFrame.unionByName, summed).groupBy("_set").agg(*added), "_set").drop("_set")
    by_whole = split.join(by_part, ["_cluster", "_part"]).groupBy("_whole").agg(*added)
    # a set is short beside its sums, and a group has one set
    return grouped.join(whole.join(by_whole, "_whole"), "_packages").select(*group, *V.SIZES)


def linked_by_modules(sites: DataFrame, sizes: list[Column], least: int = _HOT_ROWS) -> DataFrame:
    """What the `module_breakdown` of the sites of each file and runtime links, each module once.

    `sizes` are the five sizes of a module from its `bytes`.
    """
    group = ["workspace", "source_file", "runtime"]

    def summed(parts):
        once = parts.select(*group, "module_path", *sizes).groupBy(*group, "module_path").agg(*[F.max(size).alias(size) for size in V.SIZES])
        return once.groupBy(*group).agg(*[F.sum(size).alias(size) for size in V.SIZES])

    return by_file(sites, group, summed, summed, least)


def file_costs(
    sites: DataFrame, module_sizes: DataFrame | None, failed_groups: DataFrame, linked_sums: DataFrame | None = None
) -> DataFrame:
    """Cost per file, each module counted once per runtime.

    `sites`: workspace, source_file, runtime, package_state (installed /
    not_installed / path_alias / unresolved), the five sizes and diagnostics of
    the import.
    `module_sizes`: workspace, source_file, runtime, module_path and the five
    sizes of the module as linked for that file; repeated where several imports
    reach it.
    `failed_groups`: workspace, source_file, runtime, stage of combined builds
    that failed; those fall back to A10 and make the file degraded.
    """
    file = ["workspace", "source_file"]
    group = [*file, "runtime"]
    diagnostics = F.col("diagnostics")
    measured = Q.is_measured()
    state = F.col("package_state")
    installed = state == "installed"
    empty_package = Q.is_types_only(diagnostics) | Q.is_native_binary_only(diagnostics)
    gap = (state == "not_installed") | ((state == "unresolved") & ~empty_package)
    uncounted = Q.has_uncounted(diagnostics)

    # one pass over the sites: flags and the sums a failed build falls back to
    per_group = sites.groupBy(*group).agg(
        F.count(F.lit(1)).alias("imports"),
        F.bool_or(gap).alias("gap"),
        F.bool_or(installed).alias("has_group"),
        F.bool_or(installed & measured).alias("summed_any"),
        F.bool_or(installed & (~measured | uncounted)).alias("summed_short"),
        F.bool_or(installed & uncounted).alias("linked_short"),
        *[
            F.sum(F.when(installed & measured, F.col(size))).alias(f"summed_{size}")
            for size in V.SIZES
        ],
    )
    if linked_sums is None:
        linked_sums = (
            module_sizes.groupBy(*group, "module_path")
            .agg(*[F.max(size).alias(size) for size in V.SIZES])
            .groupBy(*group)
            .agg(*[F.sum(size).alias(size) for size in V.SIZES])
        )
    linked = linked_sums.withColumn("linked", F.lit(True))
    failed = failed_groups.groupBy(*group).agg(F.max("stage").alias("failed_stage"))
    joined = per_group.join(linked, group, "left").join(failed, group, "left")
    broken = F.col("failed_stage").isNotNull() & F.col("has_group")
    combined = F.coalesce("linked", F.lit(False)) & ~broken

    files = joined.groupBy(*file).agg(
        F.sum("imports").alias("imports"),
        F.bool_or("gap").alias("gap"),
        F.bool_or("has_group").alias("has_group"),
        F.bool_or(combined | (broken & F.col("summed_any"))).alias("sized_any"),
        F.bool_or(
            (broken & F.col("summed_short")) | (combined & F.col("linked_short"))
        ).alias("short"),
        F.bool_or(broken).alias("degraded"),
        F.max(F.when(broken, F.col("failed_stage"))).alias("failed_stage"),
        *[
            F.coalesce(
                F.sum(
                    F.when(broken, F.col(f"summed_{size}")).when(combined, F.col(size))
                ),
                F.lit(0),
            ).alias(size)
            for size in V.SIZES
        ],
    )
    unsized = F.col("has_group") & ~F.col("sized_any")
    return files.select(
        *file,
        "imports",
        *[F.when(~unsized, F.col(size)).alias(size) for size in V.SIZES],
        (F.col("gap") | F.col("short")).alias("incomplete"),
        "degraded",
        "failed_stage",
        F.when(unsized, "no import could be sized conservatively").alias("error"),
    )


def is_cacheable(error, incomplete, degraded, conflicting, diagnostics):
    """Whether a file cost may be stored."""
    return (
        error.isNull()
        & ~incomplete
        & ~degraded
        & ~F.coalesce(conflicting, F.lit(False))
        & ~F.coalesce(
            F.exists(diagnostics, lambda d: d["stage"].isin(V.TRANSIENT_STAGES)), F.lit(False)
        )
    )


def joined_artifacts(
    parts: DataFrame,
    keys: list[str],
    max_total_bytes: int | None = None,
    max_module_bytes: int | None = None,
    max_modules: int | None = None,
) -> DataFrame:
    """One text per artifact: its distinct modules in path order.

    Limits are off unless given. An artifact over one gets the `module_graph_limit`
    verdict from its sizes instead of a text.
    """
    modules = parts.groupBy(*keys, "module_path").agg(F.max("text").alias("text"))
    joined = (
        lambda rows: rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("module_path", "text"))).alias("_parts"))
        .select(*keys, F.array_join("_parts.text", "\n").alias("text"))
        .withColumn("stage", F.lit(None).cast("string"))
    )
    if max_total_bytes is None and max_module_bytes is None and max_modules is None:
        return joined(modules)
    sizes = modules.groupBy(*keys).agg(
        F.sum(F.octet_length("text")).alias("_bytes"),
        F.max(F.octet_length("text")).alias("_largest"),
        F.count(F.lit(1)).alias("_modules"),
    )
    over = F.lit(False)
    for column, limit in (("_bytes", max_total_bytes), ("_largest", max_module_bytes), ("_modules", max_modules)):
        over = over if limit is None else over | (F.col(column) > limit)
    refused = sizes.where(over).select(
        *keys, F.lit(None).cast("string").alias("text"), F.lit("module_graph_limit").alias("stage")
    )
    return joined(modules.join(sizes.where(~over).select(*keys), keys, "left_semi")).unionByName(refused)


def artifact_sizes(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Raw, gzip 6, brotli 9 and zstd 3 bytes of each artifact's whole text.

    Arrow batches stream through the codecs; there is no grouping. NULL text
    stays unmeasured.
    """
    ship_package(artifacts.sparkSession)
    chosen = spread(artifacts.select(*keys, "text"))
    fields = [field for field in chosen.schema.fields if field.name != "text"]
    schema = ", ".join(
        [f"`{field.name}` {field.dataType.simpleString()}" for field in fields]
        + ["raw_bytes long", "gzip_bytes long", "brotli_bytes long", "zstd_bytes long"]
    )
    names = [field.name for field in fields]

    def compress(batches):
        codecs = [pa.Codec("gzip", 6), pa.Codec("brotli", 9), pa.Codec("zstd", 3)]
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                data = value.as_py()
                data = None if data is None else data.encode("utf-8")
                rows.append(
                    [None] * 4
                    if data is None
                    else [len(data)] + [len(codec.compress(data)) for codec in codecs]
                )
            sizes = [pa.array([row[n] for row in rows], pa.int64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names] + sizes,
                names=[*names, "raw_bytes", "gzip_bytes", "brotli_bytes", "zstd_bytes"],
            )

    return chosen.mapInArrow(compress, schema)


# fixed values: how asset kinds are shown
ASSET_LABELS = {"css": "CSS", "wasm": "wasm", "font": "Fonts"}


def file_summaries(
    costs: DataFrame, statuses: DataFrame, breakdown: DataFrame, deltas: DataFrame, mode: str = "brotli"
) -> DataFrame:
    """One line per file: quantity, sizes, imports, assets, skipped, change.

    `costs` has the sizes, incomplete, degraded, diagnostics; `statuses` one row
    per import with its status; `deltas` a `delta_label` per file. A file has at
    most one row per asset kind, so the text parts are bounded.
    """
    file = ["workspace", "source_file"]
    counted = statuses.groupBy(*file).agg(
        F.count(F.lit(1)).alias("import_count"),
        F.count_if(F.col("status").isin("missing", "unavailable")).alias("skipped"),
    )
    size = labels.bytes_for_compression(mode)
    wide = breakdown.groupBy(*file).agg(
        *[F.sum(F.when(F.col("kind") == kind, size)).alias(f"_{kind}") for kind in ASSET_LABELS]
    )
    joined = (
        costs.join(counted, file)
        .join(wide, file, "left")
        .join(deltas.select(*file, "delta_label"), file, "left")
    )
    quality = Q.file_cost_quality(F.col("diagnostics"), F.col("incomplete"), F.col("degraded"))
    short = labels.compression_label(mode)
    assets = [
        F.when(
            F.col(f"_{kind}") > 0,
            F.concat(F.lit(f"{label} "), labels.format_bytes(F.col(f"_{kind}"))),
        )
        for kind, label in ASSET_LABELS.items()
    ]
    text = F.concat_ws(
        Q.DOT,
        F.concat(F.col("_q.name"), F.lit(": "), labels.format_bytes(size), F.lit(f" {short}")),
        F.concat(labels.format_bytes(F.col("minified_bytes")), F.lit(" min")),
        F.concat(
            F.col("import_count").cast("string"),
            F.when(F.col("import_count") == 1, " import").otherwise(" imports"),
        ),
        *assets,
        F.when(F.col("skipped") > 0, F.format_string("%d skipped", "skipped")),
        F.col("delta_label"),
    )
    return joined.withColumn("_q", quality).select(
        *file, "import_count", "skipped", F.col("_q.is_file_cost").alias("is_file_cost"), text.alias("summary")
    )
