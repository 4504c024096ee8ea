"""Comparisons: requested imports, substitutions, accuracy, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import quality as Q
from ballast.operators import ranges


def not_analysed(requested: DataFrame, analysed: DataFrame, keys: list[str]) -> DataFrame:
    """Requested imports no analysis row exists for."""
    return requested.join(analysed.select(*keys).distinct(), keys, "left_anti")


def import_rank(measured: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Cheapest first within each comparison; ties keep their order."""
    return ranges.row_numbers(measured, keys, [F.col("brotli_bytes"), F.col(tie)], "position")


def compare_imports(requested: DataFrame, analysed: DataFrame, keys: list[str]) -> DataFrame:
    """Every requested import exactly once: ranked, unsized or not analysed.

    `keys` names the comparison and ends with `specifier`; `analysed` carries the
    sizes, `error`, `message` and `has_result`.
    """
    group = keys[:-1]
    none = F.lit(None)
    ranked = import_rank(analysed.where(Q.is_measured()), group, "specifier").select(
        *keys,
        F.lit("compared").alias("outcome"),
        F.col("position").cast("int").alias("position"),
        "brotli_bytes",
        none.cast("string").alias("reason"),
    )
    reason = F.when(
        ~F.col("has_result"), F.coalesce("message", F.lit("no result for this import"))
    ).otherwise(F.coalesce("error", F.lit("no size was produced for this import")))
    unsized = analysed.where(~Q.is_measured()).select(
        *keys,
        F.lit("unsized").alias("outcome"),
        none.cast("int").alias("position"),
        none.cast("long").alias("brotli_bytes"),
        reason.alias("reason"),
    )
    absent = not_analysed(requested.select(*keys), analysed, keys).select(
        *keys,
        F.lit("not_analysed").alias("outcome"),
        none.cast("int").alias("position"),
        none.cast("long").alias("brotli_bytes"),
        F.lit("not a package import that can be sized").alias("reason"),
    )
    return ranked.unionByName(unsized).unionByName(absent)


def comparison_counts(compared: DataFrame, group: list[str]) -> DataFrame:
    return compared.groupBy(*group).agg(
        F.count_if(F.col("outcome") == "compared").alias("compared_count"),
        F.count_if(F.col("outcome") != "compared").alias("excluded_count"),
    )


def substitution_table(spark) -> DataFrame:
    return spark.createDataFrame(
        V.SUBSTITUTIONS, "wanted string, position int, suggestion string, reason string"
    )


def substitutions(sites: DataFrame, table: DataFrame) -> DataFrame:
    """Suggestions by specifier, else by package. A specifier hit hides the
    package's own suggestions."""
    by_name = table.groupBy("wanted").agg(
        F.array_sort(F.collect_list(F.struct("position", "suggestion", "reason"))).alias("_list")
    )
    own = by_name.select(F.col("wanted").alias("specifier"), F.col("_list").alias("_own"))
    package = by_name.select(F.col("wanted").alias("package_name"), F.col("_list").alias("_package"))
    joined = sites.join(own, "specifier", "left").join(package, "package_name", "left")
    found = joined.withColumn("_found", F.explode(F.coalesce("_own", "_package")))
    return found.select(
        *sites.columns,
        F.col("_found.position").alias("position"),
        F.col("_found.suggestion").alias("suggestion"),
        F.col("_found.reason").alias("reason"),
    )


def accuracy_compare(
    measured: DataFrame,
    oracle: DataFrame,
    assets: DataFrame | None = None,
    expected_assets: DataFrame | None = None,
    excluded: DataFrame | None = None,
    modules: DataFrame | None = None,
) -> DataFrame:
    """Relative deltas against another tool, with per-benchmark tolerances.

    `oracle` has label, brotli_bytes, minified_bytes and the nullable tolerance
    and minified_tolerance. The optional tables add the asset check (exactly one
    contribution of the expected size per kind) and the excluded-module check.
    """
    other = oracle.select(
        "label",
        F.col("brotli_bytes").alias("_brotli"),
        F.col("minified_bytes").alias("_minified"),
        F.coalesce("tolerance", F.lit(V.ACCURACY_TOLERANCE)).alias("tolerance"),
        "minified_tolerance",
    )

    def delta(own, reference):
        return F.abs(own - reference) / F.greatest(reference, F.lit(1))

    joined = measured.join(other, "label").select(
        "label",
        delta(F.col("brotli_bytes"), F.col("_brotli")).alias("brotli_delta"),
        delta(F.col("minified_bytes"), F.col("_minified")).alias("minified_delta"),
        "tolerance",
        "minified_tolerance",
    )
    verdict = (F.col("brotli_delta") <= F.col("tolerance")) & (
        F.col("minified_tolerance").isNull() | (F.col("minified_delta") <= F.col("minified_tolerance"))
    )
    result = joined.withColumn("within", verdict)
    if assets is not None and expected_assets is not None:
        kinds = assets.groupBy("label", "kind").agg(
            F.count(F.lit(1)).alias("_n"), F.max("raw_bytes").alias("_raw")
        )
        exact = (F.coalesce("_n", F.lit(0)) == 1) & (F.col("_raw") == F.col("bytes"))
        checked = (
            expected_assets.join(kinds, ["label", "kind"], "left")
            .groupBy("label")
            .agg(F.bool_and(F.coalesce(exact, F.lit(False))).alias("_assets"))
        )
        result = result.join(checked, "label", "left").withColumn(
            "within", F.col("within") & F.coalesce("_assets", F.lit(True))
        ).drop("_assets")
    if excluded is not None and modules is not None:
        hits = (
            modules.join(excluded, "label")
            .where(F.translate("path", "\\", "/").endswith(F.col("excluded_module")))
            .select("label")
            .distinct()
            .withColumn("_hit", F.lit(True))
        )
        result = result.join(hits, "label", "left").withColumn(
            "within", F.col("within") & F.col("_hit").isNull()
        ).drop("_hit")
    return result


def latency_summary(samples: DataFrame, keys: list[str], min_samples: int = V.LATENCY_MIN_SAMPLES) -> DataFrame:
    """Nearest-rank p50, p95 and max per group of at least `min_samples`."""
    counts = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.max("millis").alias("max_millis")
    ).where(F.col("samples") >= min_samples)
    n = F.col("samples")
    ranks = counts.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("p50").alias("label"), F.expr("samples div 2").alias("rank")),
                F.struct(
                    F.lit("p95").alias("label"), F.expr("(samples * 95 + 99) div 100 - 1").alias("rank")
                ),
            )
        ).alias("_r"),
    ).select(*keys, "_r.label", "_r.rank")
    placed = ranges.at_ranks(samples, keys, "millis", ranks)
    wide = placed.groupBy(*keys).agg(
        F.max(F.when(F.col("label") == "p50", F.col("value"))).alias("p50_millis"),
        F.max(F.when(F.col("label") == "p95", F.col("value"))).alias("p95_millis"),
    )
    return counts.join(wide, keys).select(*keys, n.alias("samples"), "p50_millis", "p95_millis", "max_millis")
