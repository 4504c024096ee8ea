"""What a measurement is worth: measured, transient, durable, budgetable.

NULL is never 0. `diagnostics` is an array of structs with a `stage` field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast import vocabulary as V

DOT = " · "


def _any_stage(diagnostics: Column, stages: list[str]) -> Column:
    return F.coalesce(F.exists(diagnostics, lambda d: d["stage"].isin(stages)), F.lit(False))


def is_measured(sizes: list[Column] | None = None) -> Column:
    """All five sizes are there."""
    columns = sizes or [F.col(name) for name in V.SIZES]
    verdict = columns[0].isNotNull()
    for column in columns[1:]:
        verdict = verdict & column.isNotNull()
    return verdict


def is_transient(diagnostics: Column, unmeasured_stage: Column) -> Column:
    """Describes this run, not the package."""
    own = F.coalesce(unmeasured_stage.isin(V.TRANSIENT_STAGES), F.lit(False))
    return own | _any_stage(diagnostics, V.TRANSIENT_STAGES)


def is_durable(diagnostics: Column, unmeasured_stage: Column) -> Column:
    """Every stage is on the allowlist; an unknown stage is not."""
    own = unmeasured_stage.isNull() | unmeasured_stage.isin(V.DURABLE_STAGES)
    rest = F.forall(diagnostics, lambda d: F.coalesce(d["stage"].isin(V.DURABLE_STAGES), F.lit(False)))
    return own & F.coalesce(rest, F.lit(True))


def is_imprecise(diagnostics: Column) -> Column:
    return _any_stage(diagnostics, V.NON_BUDGETABLE_STAGES)


def is_budgetable(diagnostics: Column, unmeasured_stage: Column) -> Column:
    """Precise enough for a budget verdict."""
    return is_measured() & is_durable(diagnostics, unmeasured_stage) & ~is_imprecise(diagnostics)


def has_uncounted(diagnostics: Column) -> Column:
    """Ships bytes that are not in its size."""
    return _any_stage(diagnostics, ["uncounted_assets"])


def is_types_only(diagnostics: Column) -> Column:
    return is_measured() & _any_stage(diagnostics, ["types_only"])


def is_native_binary_only(diagnostics: Column) -> Column:
    return is_measured() & _any_stage(diagnostics, ["native_binary_only"])


def is_native_binary(diagnostics: Column) -> Column:
    return is_measured() & _any_stage(diagnostics, ["native_binary"])


def is_conservative(has_result: Column, is_cjs: Column, side_effects: Column, shakeable: Column) -> Column:
    """The size is a conservative reading."""
    return has_result & F.coalesce(is_cjs | side_effects | ~shakeable, F.lit(False))


def truly_treeshakeable(
    kind: Column, named: Column, side_effects: Column, minified: Column, full_minified: Column
) -> Column:
    """A named import clearly smaller than the whole package."""
    eligible = (kind == "named") & (F.size(named) > 0) & ~side_effects & (full_minified > 0)
    return F.coalesce(eligible & (minified / full_minified <= V.TREESHAKE_RATIO), F.lit(False))


def confidence(measured: Column, side_effects: Column, diagnostics: Column) -> Column:
    """High, medium, or low when nothing was measured."""
    clean = ~side_effects & (F.size(diagnostics) == 0)
    return F.when(~measured, "low").when(clean, "high").otherwise("medium")


def confidence_reasons(measured: Column, side_effects: Column, diagnostics: Column) -> Column:
    """Why the confidence is below high, as a sorted list of causes."""
    stages = F.array_sort(F.array_distinct(F.transform(diagnostics, lambda d: d["stage"])))
    declared = F.when(side_effects, F.array(F.lit("side_effects"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(~measured, F.array(F.lit("not_measured"))).otherwise(F.concat(declared, stages))


def confidence_label(has_result: Column, level: Column) -> Column:
    """The level, or `unknown` without a result."""
    return F.when(has_result, level).otherwise("unknown")


def over_import_budget(diagnostics: Column, unmeasured_stage: Column, limit: Column) -> Column:
    """Strictly over the limit, on a size precise enough to judge."""
    verdict = is_budgetable(diagnostics, unmeasured_stage) & (F.col("brotli_bytes") > limit)
    return F.coalesce(verdict, F.lit(False))


def row_warning(limit: Column, has_result: Column) -> Column:
    """P20: the warning text of a report row, in fixed order."""
    diagnostics, stage = F.col("diagnostics"), F.col("unmeasured_stage")
    shared = F.coalesce(F.col("shared_bytes"), F.lit(0))
    reasons = F.array_join(F.col("confidence_reasons"), DOT)
    suffix = F.when(F.size("confidence_reasons") > 0, F.concat(F.lit(": "), reasons)).otherwise("")
    return F.concat_ws(
        DOT,
        F.col("warning"),
        F.when(has_result, F.col("error")),
        F.when(
            has_result & (shared > 0),
            F.format_string("Shares %d B with other imports in this file", shared),
        ),
        F.when(
            has_result & over_import_budget(diagnostics, stage, limit),
            F.format_string("Budget exceeded: %d B br > %d B br", F.col("brotli_bytes"), limit),
        ),
        F.when(
            is_conservative(
                has_result, F.col("is_cjs"), F.col("side_effects"), F.col("truly_treeshakeable")
            ),
            "Conservative estimate",
        ),
        F.when(has_result & (F.col("confidence") == "low"), F.concat(F.lit("Low confidence"), suffix)),
        F.when(
            has_result & (F.col("confidence") == "medium"),
            F.concat(F.lit("Medium confidence"), suffix),
        ),
    )


def file_cost_quality(diagnostics: Column, incomplete: Column, degraded: Column) -> Column:
    """Which quantity a file total is, and in which direction it may be wrong."""
    short = incomplete | (~degraded & _any_stage(diagnostics, V.TRANSIENT_STAGES))
    imprecise = is_imprecise(diagnostics)
    name = (
        F.when(degraded, "Combined Import Cost")
        .when(short & imprecise, "File Cost, bound in neither direction")
        .when(short, "File Cost floor")
        .when(imprecise, "File Cost upper bound")
        .otherwise("File Cost")
    )
    return F.struct(
        F.when(degraded, "combined-import-cost").otherwise("file-cost").alias("quantity"),
        short.alias("short"),
        imprecise.alias("imprecise"),
        name.alias("name"),
        (~degraded & ~short & ~imprecise).alias("is_file_cost"),
    )


def tree_shake_reason() -> Column:
    """Why a measured import cannot be shaken."""
    return F.when(
        is_measured(),
        F.when(F.col("is_cjs"), "CommonJS import may block precise tree-shaking.")
        .when(F.col("side_effects"), "Package side effects require conservative sizing.")
        .when(
            ~F.col("truly_treeshakeable"),
            "Import is not tree-shakeable by the current analysis.",
        ),
    )


def narrowing_candidate(status: Column, kind: Column, shakeable: Column) -> Column:
    """A whole-namespace import that named imports could narrow."""
    return (
        (status == "ready")
        & is_measured()
        & (kind == "namespace")
        & ~F.coalesce(shakeable, F.lit(False))
    )


def result_tags(diagnostics: Column, runtime: Column, is_cjs: Column) -> Column:
    """Short tags shown next to a size."""
    tags = F.array(
        F.when(runtime == "server", "server"),
        F.when(is_types_only(diagnostics), "types only"),
        F.when(is_native_binary_only(diagnostics), "native binary only").when(
            is_native_binary(diagnostics), "native binary"
        ),
        F.when(is_cjs, "CJS"),
    )
    return F.filter(tags, lambda tag: tag.isNotNull())


def selection(kind: Column, named: Column) -> Column:
    """Which part of a package an import asks for."""
    return (
        F.when((kind == "named") & (F.size(named) > 0), "named")
        .when(kind.isin("named", "dynamic"), "full")
        .otherwise(kind)
    )


def uncounted_assets_message(assets: Column) -> Column:
    """One sentence on assets a size leaves out; `assets` holds (path, bytes)."""
    total = F.aggregate(assets, F.lit(0).cast("long"), lambda acc, a: acc + a["bytes"])
    known = F.forall(assets, lambda a: a["bytes"] > 0)
    amount = (
        F.when(known, F.format_string("totalling %d bytes", total))
        .when(total > 0, F.format_string("totalling at least %d bytes", total))
        .otherwise("of unknown size")
    )
    names = F.array_join(F.transform(assets, lambda a: F.substring_index(a["path"], "/", -1)), ", ")
    return F.format_string(
        "package ships %d non-JavaScript asset(s) %s that this size does NOT include: %s",
        F.size(assets),
        amount,
        names,
    )
