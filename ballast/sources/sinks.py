"""Report and history sinks. Tables are plain parquet; swaps are per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.operators import history as H
from ballast.operators import report as R
from ballast.session import pinned


def _parts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "workspace", "specifier", F.explode("module_contributions").alias("_m")
    ).select(
        "workspace", "specifier", F.col("_m.path").alias("module_path"), F.col("_m.bytes").alias("bytes")
    )


def report_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The row table and its derived tables."""
    parts = _parts(rows)
    by_workspace = ["workspace"]
    return {
        "rows": rows,
        "summary": R.report_summary(rows),
        "duplicates": R.duplicate_imports(rows, by_workspace),
        "duplicate_files": R.duplicate_import_files(rows, by_workspace),
        "shared_modules": R.shared_modules(parts, by_workspace),
        "shared_module_specifiers": R.shared_module_specifiers(parts, by_workspace),
        "treemap": R.treemap_shares(rows),
    }


def write_report(rows: DataFrame, folder: str, form: str = "parquet") -> dict[str, str]:
    """Write every table of the report below `folder`.

    Rows are written once; the derived tables read what was written, so the
    report behind them is computed one time and survives lost executors. What two of
    them count alike is counted once, and lists are cut by the groups already written. The
    rebalance hint lets Spark split a workspace with most of the rows into several
    files and join small ones.
    """
    spark = rows.sparkSession
    target = f"{folder.rstrip('/')}/rows"
    rows.hint("rebalance", "workspace").write.mode("overwrite").partitionBy("workspace").format(
        form
    ).save(target)
    paths = {"rows": target}
    stored = spark.read.schema(rows.schema).format(form).load(target)

    def written(name: str, table: DataFrame) -> DataFrame:
        paths[name] = f"{folder.rstrip('/')}/{name}"
        table.write.mode("overwrite").format(form).save(paths[name])
        return spark.read.schema(table.schema).format(form).load(paths[name])

    by_workspace = ["workspace"]
    written("summary", R.report_summary(stored))
    per_file = pinned(R.imports_per_file(stored, by_workspace))
    duplicates = written("duplicates", R.repeated_imports(per_file, by_workspace))
    written("duplicate_files", R.repeated_import_files(per_file, duplicates, by_workspace))
    uses = pinned(R.module_uses(_parts(stored), by_workspace))
    shared = written("shared_modules", R.used_repeatedly(uses, by_workspace))
    written("shared_module_specifiers", R.repeated_specifiers(uses, shared, by_workspace))
    written("treemap", R.treemap_shares(stored))
    return paths


def append_history(
    history: DataFrame, new_rows: DataFrame, tie: str, limit: int = V.FILE_HISTORY_ROWS
) -> DataFrame:
    """Newest-first append with the cap of W4, per workspace."""
    merged = history.unionByName(new_rows)
    return H.history_cap(merged, ["workspace"], tie, limit).drop("age_rank")


def upsert_history(
    history: DataFrame, new_rows: DataFrame, keys: list[str], tie: str, limit: int = V.IMPORT_HISTORY_ROWS
) -> DataFrame:
    """Replace per identity where any of the five sizes changed, then cap.

    Rows with unchanged sizes leave the stored row as it is.
    """
    stored = history.select(*keys, *[F.col(size).alias(f"_old_{size}") for size in V.SIZES]).withColumn(
        "_known", F.lit(True)
    )
    same = F.lit(True)
    for size in V.SIZES:
        same = same & F.col(size).eqNullSafe(F.col(f"_old_{size}"))
    changed = new_rows.join(stored, keys, "left").where(F.col("_known").isNull() | ~same).select(
        *new_rows.columns
    )
    retained = history.join(changed.select(*keys).distinct(), keys, "left_anti")
    # the store is per workspace, so `keys` starts with it
    return H.history_cap(retained.unionByName(changed), ["workspace"], tie, limit).drop("age_rank")


def write_table(frame: DataFrame, path: str) -> DataFrame:
    """Write, then read back: the next version of a table never overwrites the
    files it is computed from."""
    frame.write.mode("errorifexists").parquet(path)
    spark: SparkSession = frame.sparkSession
    return spark.read.schema(frame.schema).parquet(path)
