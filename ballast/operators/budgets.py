"""Budgets: three-valued verdicts; a floor is never judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import quality as Q
from ballast.session import pinned


def positive_budget(value: Column) -> Column:
    """Finite and above zero, floored; anything else is no budget."""
    number = value.cast("double")
    usable = (number > 0) & ~F.isnan(number) & (number != float("inf"))
    return F.when(usable, F.floor(number).cast("long"))


def file_budget_verdict(usable: Column, brotli: Column, limit: Column) -> Column:
    """not_evaluated / within / over."""
    return (
        F.when(limit.isNull() | ~usable, "not_evaluated")
        .when(brotli > limit, "over")
        .otherwise("within")
    )


def usable_file_cost(error: Column, incomplete: Column, degraded: Column, diagnostics: Column) -> Column:
    """A complete, combined, precise total of this run."""
    blocked = F.coalesce(
        F.exists(
            diagnostics,
            lambda d: d["stage"].isin(V.TRANSIENT_STAGES + V.NON_BUDGETABLE_STAGES),
        ),
        F.lit(False),
    )
    return error.isNull() & ~incomplete & ~degraded & ~blocked


def violation_counts(sites: DataFrame, files: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per workspace, imports over their budget and files by verdict."""
    over = Q.over_import_budget(
        F.col("diagnostics"), F.col("unmeasured_stage"), F.col("per_import_brotli_bytes")
    )
    imports = (
        sites.join(budgets, "workspace", "left")
        .groupBy("workspace")
        .agg(F.count_if((F.col("status") == "ready") & over).alias("imports_over"))
    )
    verdict = file_budget_verdict(
        usable_file_cost(
            F.col("error"), F.col("incomplete"), F.col("degraded"), F.col("diagnostics")
        ),
        F.col("brotli_bytes"),
        F.col("per_file_brotli_bytes"),
    )
    judged = files.join(budgets, "workspace", "left").withColumn("verdict", verdict)
    by_file = judged.groupBy("workspace").agg(
        *[
            F.count_if(F.col("verdict") == name).alias(f"files_{name}")
            for name in ("over", "within", "not_evaluated")
        ]
    )
    return imports.join(by_file, "workspace", "full")


def _blocking(diagnostics: Column, unmeasured_stage: Column) -> Column:
    """An import whose state keeps a gate from giving a verdict: a transient
    failure, or a measurement that is not durable or not precise."""
    own = F.coalesce(unmeasured_stage.isin(V.TRANSIENT_STAGES), F.lit(False))
    shaky = Q.is_measured() & (~Q.is_durable(diagnostics, F.lit(None).cast("string")) | Q.is_imprecise(diagnostics))
    return F.when(Q.is_measured(), shaky).otherwise(own)


def gate_findings(files: DataFrame, imports: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row per finding of the changed files: `could_not_measure`,
    `file_over`, `import_over`. Both lists are always produced in full."""
    key = ["workspace", "source_file"]
    extension = F.regexp_extract("source_file", r"\.([^./]*)$", 1)
    blocked = (
        imports.where(_blocking(F.col("diagnostics"), F.col("unmeasured_stage")))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("blocked_imports"))
    )
    has_budget = (
        F.col("per_file_brotli_bytes").isNotNull() | F.col("per_import_brotli_bytes").isNotNull()
    )
    checked = (
        files.where(extension.isin(V.GATE_EXTENSIONS))
        .join(budgets.where(has_budget), "workspace")
        .join(blocked, key, "left")
        .withColumn("blocked_imports", F.coalesce("blocked_imports", F.lit(0).cast("long")))
    )
    usable = usable_file_cost(
        F.col("error"), F.col("incomplete"), F.col("degraded"), F.col("diagnostics")
    ) & (F.col("blocked_imports") == 0)
    # read twice below by different columns, so the file costs behind it would be made twice
    judged = pinned(
        checked.select(*key, "brotli_bytes", "per_file_brotli_bytes", "per_import_brotli_bytes", usable.alias("_usable"))
    )

    def finding(name: str, actual: Column, limit: Column) -> Column:
        return F.struct(
            F.lit(name).alias("finding"),
            F.lit(None).cast("string").alias("specifier"),
            actual.cast("long").alias("actual_bytes"),
            limit.cast("long").alias("limit_bytes"),
        )

    size, limit = F.col("brotli_bytes"), F.col("per_file_brotli_bytes")
    none = F.lit(None)
    of_file = F.when(~F.col("_usable"), finding("could_not_measure", none, none)).when(
        size > limit, finding("file_over", size, limit)
    )
    of_files = (
        judged.withColumn("_finding", of_file)
        .where(F.col("_finding").isNotNull())
        .select(*key, "_finding.*")
    )
    passed = judged.where("_usable")
    precise = imports.where(
        Q.is_measured()
        & Q.is_durable(F.col("diagnostics"), F.lit(None).cast("string"))
        & ~Q.is_imprecise(F.col("diagnostics"))
    ).select(*key, "specifier", F.col("brotli_bytes").alias("actual_bytes"))
    import_over = (
        precise.join(passed.select(*key, "per_import_brotli_bytes"), key)
        .where(F.col("actual_bytes") > F.col("per_import_brotli_bytes"))
        .select(
            *key,
            F.lit("import_over").alias("finding"),
            "specifier",
            "actual_bytes",
            F.col("per_import_brotli_bytes").alias("limit_bytes"),
        )
    )
    return of_files.unionByName(import_over)


def gate_verdict(findings: DataFrame, budgets: DataFrame) -> DataFrame:
    """Exit code per workspace: 3 when anything could not be measured, else
    1 for a violation, else 0. No budgets is 0."""
    code = F.when(F.col("finding") == "could_not_measure", 3).otherwise(1)
    worst = findings.groupBy("workspace").agg(
        F.max(code).alias("_code"),
        F.count_if(F.col("finding") == "could_not_measure").alias("could_not_measure"),
        F.count_if(F.col("finding") != "could_not_measure").alias("violations"),
    )
    zero = F.lit(0).cast("long")
    return budgets.select("workspace").join(worst, "workspace", "left").select(
        "workspace",
        F.coalesce("_code", F.lit(0)).alias("exit_code"),
        F.coalesce("could_not_measure", zero).alias("could_not_measure"),
        F.coalesce("violations", zero).alias("violations"),
    )


