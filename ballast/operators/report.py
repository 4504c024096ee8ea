"""The workspace report: rows, summary, duplicates, shared modules, treemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import quality as Q
from ballast.functions import specifiers as S


def top_modules_text(modules: Column) -> Column:
    """The first three modules as `name (N B)`."""
    return F.array_join(
        F.transform(
            F.slice(modules, 1, 3),
            lambda m: F.concat(
                S.basename(m["path"]), F.lit(" ("), m["bytes"].cast("string"), F.lit(" B)")
            ),
        ),
        ", ",
    )


def report_rows(sites: DataFrame, budgets: DataFrame) -> DataFrame:
    """A1: one row per import site. Sizes keep NULL; only shared bytes default to 0.

    `has_result` says whether a measurement row exists at all.
    """
    limited = sites.join(budgets, "workspace", "left")
    has_result = F.col("has_result")
    return limited.select(
        "workspace",
        "package_name",
        "specifier",
        S.relative_source_file(F.col("workspace_root"), F.col("source_file")).alias("source_file"),
        (F.col("line") + 1).alias("line"),
        "runtime",
        *[F.when(has_result, F.col(size)).alias(size) for size in V.SIZES[1:]],
        F.coalesce(F.when(has_result, F.col("shared_bytes")), F.lit(0).cast("long")).alias("shared_bytes"),
        Q.confidence_label(has_result, F.col("confidence")).alias("confidence"),
        F.coalesce(
            F.when(has_result, F.array_join("confidence_reasons", Q.DOT)), F.lit("")
        ).alias("confidence_reasons"),
        F.coalesce(F.when(has_result, top_modules_text(F.col("module_breakdown"))), F.lit("")).alias(
            "top_modules"
        ),
        Q.row_warning(F.col("per_import_brotli_bytes"), has_result).alias("warning"),
        F.when(has_result, F.col("module_breakdown")).alias("module_contributions"),
        Q.is_conservative(
            has_result, F.col("is_cjs"), F.col("side_effects"), F.col("truly_treeshakeable")
        ).alias("is_conservative"),
        (
            has_result
            & Q.over_import_budget(
                F.col("diagnostics"), F.col("unmeasured_stage"), F.col("per_import_brotli_bytes")
            )
        ).alias("over_budget"),
    )


def position_text() -> Column:
    return F.concat_ws(":", F.col("source_file"), F.col("line").cast("string"), F.col("specifier"))


def report_order(rows: DataFrame) -> DataFrame:
    """Largest first, unmeasured last, then the position as text."""
    return rows.orderBy(F.col("brotli_bytes").desc_nulls_last(), position_text())


def report_summary(rows: DataFrame) -> DataFrame:
    """A2: counts and the Combined Import Cost per workspace."""
    return rows.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("import_count"),
        F.coalesce(F.sum("brotli_bytes"), F.lit(0)).alias("combined_brotli_bytes"),
        F.count_if(F.col("confidence") == "low").alias("low_confidence_count"),
        F.count_if(F.col("confidence") == "medium").alias("medium_confidence_count"),
        F.count_if("is_conservative").alias("conservative_count"),
        F.count_if("over_budget").alias("budget_violation_count"),
    )


def imports_per_file(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A3: imports of each specifier in each file; both tables of duplicates come from it."""
    return rows.groupBy(*keys, "specifier", "source_file").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("brotli_bytes").alias("_brotli")
    )


def repeated_imports(per_file: DataFrame, keys: list[str]) -> DataFrame:
    return (
        per_file.groupBy(*keys, "specifier")
        .agg(
            F.sum("_n").alias("import_count"),
            F.coalesce(F.sum("_brotli"), F.lit(0)).alias("combined_brotli_bytes"),
            F.count(F.lit(1)).alias("file_count"),
        )
        .where(F.col("import_count") > 1)
    )


def repeated_import_files(per_file: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    listed = per_file.select(*keys, "specifier", "source_file", F.col("_n").alias("imports_in_file"))
    return listed.join(repeated.select(*keys, "specifier"), [*keys, "specifier"], "left_semi")


def duplicate_imports(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A3: specifiers imported more than once. Two-level counting: rows per
    (specifier, file) combine first, so a popular specifier reaches its final
    task as one counter per file."""
    return repeated_imports(imports_per_file(rows, keys), keys)


def duplicate_import_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A3: the files of each duplicate, one row per file instead of one array per
    specifier, so the list has no size limit."""
    per_file = imports_per_file(rows, keys)
    return repeated_import_files(per_file, repeated_imports(per_file, keys), keys)


def order_duplicates(groups: DataFrame) -> DataFrame:
    return groups.orderBy(
        F.col("import_count").desc(), F.col("combined_brotli_bytes").desc(), F.col("specifier")
    )


def module_uses(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A4: uses of each module by each specifier; both tables of shared modules come from it."""
    return parts.groupBy(*keys, "module_path", "specifier").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("bytes").alias("_max"),
        F.sum("bytes").alias("_sum"),
    )


def used_repeatedly(uses: DataFrame, keys: list[str]) -> DataFrame:
    return (
        uses.groupBy(*keys, "module_path")
        .agg(
            F.sum("_n").alias("import_count"),
            F.max("_max").alias("module_bytes"),
            F.sum("_sum").alias("combined_bytes"),
            F.count(F.lit(1)).alias("specifier_count"),
        )
        .where(F.col("import_count") > 1)
        .withColumn("basename", S.basename(F.col("module_path")))
        .withColumn("vendored", S.is_vendored(F.col("module_path")))
    )


def repeated_specifiers(uses: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    listed = uses.select(*keys, "module_path", "specifier")
    return listed.join(repeated.select(*keys, "module_path"), [*keys, "module_path"], "left_semi")


def shared_modules(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A4: modules reached by more than one import. A module's own size is the
    MAX over its builds; what the sites pay together is the SUM."""
    return used_repeatedly(module_uses(parts, keys), keys)


def shared_module_specifiers(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A4: the specifiers of each shared module, one row each."""
    uses = module_uses(parts, keys)
    return repeated_specifiers(uses, used_repeatedly(uses, keys), keys)


def treemap_shares(rows: DataFrame, k: int = V.TREEMAP_ROWS) -> DataFrame:
    """A5: the first rows of each workspace in report order with their share of
    the Combined Import Cost, in whole percent, half up."""
    totals = rows.groupBy("workspace").agg(F.coalesce(F.sum("brotli_bytes"), F.lit(0)).alias("_total"))
    order = Window.partitionBy("workspace").orderBy(F.col("brotli_bytes").desc(), position_text())
    first = (
        rows.where(F.col("brotli_bytes") > 0)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )
    share = F.expr("(brotli_bytes * 100 + _total div 2) div _total")
    return first.join(totals, "workspace").select(
        "workspace",
        "position",
        "package_name",
        "specifier",
        "source_file",
        "brotli_bytes",
        F.when(F.col("_total") == 0, F.lit(0).cast("long")).otherwise(share).alias("percentage"),
        "confidence",
    )


def site_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sites and distinct files, exact; counting per file first keeps the
    distinct count free of a wide expand."""
    per_file = rows.groupBy(*keys, "source_file").agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy(*keys).agg(
        F.sum("_n").alias("sites"), F.count(F.lit(1)).alias("distinct_files")
    )


#: Registers of a sketch as a power of two, and its relative standard error.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def file_sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A mergeable sketch of the distinct files of each key, a few KB that are kept beside the report.

    Sketches of days or parts unite to the sketch of all of them, so a longer range is
    counted without its rows. The exact count stays `site_counts`.
    """
    return rows.groupBy(*keys).agg(F.hll_sketch_agg("source_file", F.lit(SKETCH_BITS)).alias("files_sketch"))


def united_files(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct files of each key over all its sketches."""
    united = sketches.groupBy(*keys).agg(F.hll_union_agg("files_sketch").alias("_all"))
    return united.select(*keys, F.hll_sketch_estimate("_all").alias("estimated_files"))
