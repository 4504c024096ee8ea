"""The jobs a user runs, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import identity as I
from ballast.functions import labels
from ballast.functions import quality as Q
from ballast.functions import registry as registry_rules
from ballast.operators import (
    budgets,
    compare,
    facts,
    freshness,
    graph,
    history,
    registry,
    report,
    resolve,
    retention,
)
from ballast.session import pinned
from ballast.sources import files, script, text
from ballast.streaming import windows


def detected_sites(source_files: DataFrame, ignore_rules: DataFrame) -> DataFrame:
    """Q1, first half: sources to the import sites that are not ignored.

    The texts are read and searched once: the sites, a small part of their size,
    are pinned before the joins that read them more than once.
    """
    kept = files.scan_sources(source_files)
    sites = pinned(script.extract_imports(script.script_regions(kept)))
    return resolve.apply_ignore_rules(sites, ignore_rules)


def workspace_report(
    source_files: DataFrame,
    ignore_rules: DataFrame,
    manifests: DataFrame,
    measurements: DataFrame,
    limits: DataFrame,
) -> DataFrame:
    """Q1: report rows of every workspace. `sinks.report_tables` derives the rest.

    `measurements` carries the identity with `named` as an array, and may be
    shared by all workspaces.
    """
    sites = resolve.resolve_installed(detected_sites(source_files, ignore_rules), manifests)
    named = sites.withColumn("names", F.array_join("named", ",")).drop("named")
    stored = measurements.withColumn(
        "names", F.array_join(I.sorted_names(F.col("import_kind"), F.col("named")), ",")
    ).drop("named", "shared_bytes")
    # its size is known once pinned, so the sites move to it only if it is large
    measured = facts.attach_measurements(named, pinned(stored))
    keyed = (
        measured.withColumnRenamed("path", "source_file")
        .withColumn("has_result", F.col("status") == "ready")
        .withColumn("workspace_root", F.lit(""))
        .withColumn("warning", F.when(F.col("status") == "missing", "Package not found"))
    )
    site = ["workspace", "source_file", "runtime", "region_no", "stmt_no", "import_kind"]
    # lazy: who does not ask for shared bytes does not pay for them
    shared = facts.shared_bytes(facts.contributions(keyed.where("has_result"), site), site)
    return report.report_rows(keyed.join(shared, site, "left"), limits)


def file_cost_job(
    sites: DataFrame, aliases: DataFrame, source_files: DataFrame, module_sizes: DataFrame, failed: DataFrame
) -> DataFrame:
    """Q2: cost and quality of each file. `sites` is resolved (J1) and measured
    (J3); what is not installed is looked up among the path aliases (J19)."""
    missing = sites.where(F.col("resolution") == "missing")
    classified = resolve.classify_unresolved(missing.drop("resolution"), aliases, source_files)
    state = F.when(F.col("resolution") == "path_alias", "path_alias").otherwise("not_installed")
    entry = F.coalesce(F.col("unmeasured_stage") == "entry_resolution", F.lit(False))
    installed = sites.where(F.col("resolution") != "missing").withColumn(
        "package_state", F.when(entry, "unresolved").otherwise("installed")
    )
    every = installed.unionByName(
        classified.withColumn("package_state", state), allowMissingColumns=True
    )
    return facts.file_costs(every, module_sizes, failed)


#: What Q2 takes of a measured site; no more of it is written for later uses.
_COSTED = [
    "workspace", "source_file", "runtime", "package_name", "specifier", "status", *V.SIZES, "diagnostics", "unmeasured_stage", "build_stage",
]


def _report_costs(
    sites: DataFrame, copies: DataFrame, aliases: DataFrame, source_files: DataFrame, package_entries: DataFrame,
    edges: DataFrame, modules: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The costs of files behind Q2 and Q3, and the sites with their `package_state`. Both are pinned."""
    file = ["workspace", "source_file"]
    resolved = resolve.resolve_installed(sites.select(*_COSTED, F.col("source_file").alias("path")), copies)
    # every specifier of a workspace is classified once, so the sites are written once
    asked = resolved.where(F.col("resolution") == "missing").select("workspace", "specifier").distinct()
    classified = pinned(resolve.classify_unresolved(asked, aliases, source_files).withColumnRenamed("resolution", "_class"))
    missing = F.col("resolution") == "missing"
    entry = F.coalesce(F.col("unmeasured_stage") == "entry_resolution", F.lit(False))
    state = (
        F.when(missing & (F.col("_class") == "path_alias"), "path_alias").when(missing, "not_installed")
        .when(entry, "unresolved").otherwise("installed")
    )
    every = pinned(
        resolved.join(classified, ["workspace", "specifier"], "left").select(*_COSTED, state.alias("package_state"))
    )
    installed = every.where(F.col("package_state") == "installed")
    # a package is the owner of its walk: its modules are found once, however many files import it
    owned = package_entries.select("graph_id", F.col("package_name").alias("runtime"), "module_path")
    reached = graph.reachable_modules(owned, edges).withColumnRenamed("runtime", "package_name")
    weighed = reached.join(modules, ["graph_id", "module_path"]).select(
        "package_name", F.concat_ws("/", "graph_id", "module_path").alias("module_path"), *V.SIZES
    )
    linked = facts.linked_by_packages(installed, weighed, [*file, "runtime"])
    failed = installed.where(F.col("build_stage").isNotNull()).select(*file, "runtime", F.col("build_stage").alias("stage"))
    stages = F.when(F.col("failed_stage").isNotNull(), F.array(F.struct(F.col("failed_stage").alias("stage")))).otherwise(
        F.array().cast("array<struct<stage:string>>")
    )
    return pinned(facts.file_costs(every, None, failed, linked).withColumn("diagnostics", stages)), every


def file_cost_report(
    sites: DataFrame,
    copies: DataFrame,
    aliases: DataFrame,
    source_files: DataFrame,
    package_entries: DataFrame,
    edges: DataFrame,
    modules: DataFrame,
    artifacts: DataFrame,
    deltas: DataFrame,
) -> DataFrame:
    """Q2 in full: what each file costs, which quantity that is, and its summary line.

    `sites` is measured (J3), with `build_stage` where the combined build of its file and runtime
    failed. It is resolved to installed copies (J1) or path aliases (J19). The modules of a package
    are those its entries reach (J15), once a package and not once a file; `modules` (graph_id,
    module_path, five sizes) gives their sizes, counted once per file and runtime (A9).
    `package_entries`: package_name, graph_id, module_path. `artifacts` as in A8, `deltas` as in A17.
    """
    file = ["workspace", "source_file"]
    costs, every = _report_costs(sites, copies, aliases, source_files, package_entries, edges, modules)
    breakdown = facts.asset_breakdown(artifacts)
    assets = facts.asset_totals(breakdown).select(*file, F.col("brotli_bytes").alias("asset_bytes"))
    summaries = facts.file_summaries(costs, every.select(*file, "status"), breakdown, deltas).select(*file, "is_file_cost", "summary")
    quantity = Q.file_cost_quality(F.col("diagnostics"), F.col("incomplete"), F.col("degraded"))["name"]
    return costs.withColumn("quantity", quantity).join(assets, file, "left").join(summaries, file)


def gate_of_reports(
    changed: DataFrame, limits: DataFrame, sites: DataFrame, artifacts: DataFrame, deltas: DataFrame, **inputs: DataFrame
) -> DataFrame:
    """Q3 on top of Q2: the file costs of the report, and the gate over them. Assets and summaries say nothing to a gate."""
    listed = changed.select("workspace", "source_file").distinct()
    # other files cannot change the verdict, so they are not costed
    asked = pinned(sites.select(*_COSTED).join(listed, ["workspace", "source_file"], "left_semi"))
    costs, every = _report_costs(asked, **inputs)
    return budgets.gate_verdict(budgets.gate_findings(costs, every, limits), limits)


def budget_gate(changed: DataFrame, costs: DataFrame, imports: DataFrame, limits: DataFrame) -> DataFrame:
    """Q3: exit code per workspace for the changed files."""
    key = ["workspace", "source_file"]
    listed = changed.select(*key).distinct()
    findings = budgets.gate_findings(
        costs.join(listed, key, "left_semi"), imports.join(listed, key, "left_semi"), limits
    )
    return budgets.gate_verdict(findings, limits)


def manifest_guidance(
    manifests: DataFrame,
    installed: DataFrame,
    measurements: DataFrame,
    registry_table: DataFrame,
    now_ms: int,
) -> DataFrame:
    """Q4: dependencies of each manifest with state and version status.

    `manifests`: workspace, manifest_path, json. `measurements`: package_name,
    five sizes, diagnostics, of the default measurement of a package. What the registry
    table says is marked stale where a lookup would have to ask again (P35).
    """
    declared = text.manifest_dependencies(manifests)
    asked = declared.withColumn("package_name", F.col("name")).withColumn(
        "path", F.col("manifest_path")
    )
    placed = resolve.resolve_installed(asked, installed).drop("path")
    measured = placed.join(measurements.withColumn("_stored", F.lit(True)), "package_name", "left")
    status = (
        F.when(F.col("resolution") == "missing", "missing")
        .when(F.col("_stored").isNull(), "loading")
        .otherwise("ready")
    )
    hinted = registry.registry_hints(measured.withColumn("status", status).drop("_stored"), registry_table)
    published = F.unix_millis(F.try_to_timestamp("latest_published_at"))
    outdated = registry_rules.needs_refresh(
        F.lit("refresh_stale"), F.lit(True), F.col("latest_version").isNotNull(), F.coalesce("not_found", F.lit(False)),
        F.col("updated_at"), F.col("retry_after"), F.lit(False), F.lit(now_ms),
    )
    refresh = registry_table.select("name", F.when(outdated, "stale").alias("refresh"))
    hinted = hinted.join(refresh, "name", "left")
    return hinted.withColumn("state", labels.dependency_state(F.col("status"), F.col("diagnostics"))).withColumn(
        "version_status",
        labels.version_status(
            F.col("status"),
            F.col("latest_version"),
            F.col("is_latest"),
            F.col("refresh"),
            published,
            F.lit(now_ms),
        ),
    )


def guidance_sections(guidance: DataFrame) -> DataFrame:
    """Q4: the summary line of each manifest section (A12), from the guidance rows."""
    return registry.section_summary(guidance)


def comparison(requested: DataFrame, analysed: DataFrame, keys: list[str]) -> DataFrame:
    """Q5: every requested import once, cheapest first."""
    compared = compare.compare_imports(requested, analysed, keys)
    return compared.orderBy(*keys[:-1], F.col("position").asc_nulls_last(), "specifier")


def history_report(cost_history: DataFrame, tie: str) -> DataFrame:
    """Q6: newest cost of each file with its change and its chart position."""
    summary = history.file_summary(cost_history, tie=tie)
    series = history.history_series(cost_history, tie).select(
        "workspace", "file_name", "ts_ms", tie, "series", "x", "y"
    )
    return summary.join(series, ["workspace", "file_name", "ts_ms", tie], "left")


def store_maintenance(
    store: DataFrame, live_paths: DataFrame, analyzer_version: str, budget_bytes: int
) -> DataFrame:
    """Q7: rows to delete with the reason; orphans go first and free their bytes.

    Every row is judged once and written with what the plan needs of it.
    """
    key = ["shard_id", "key"]
    judged = pinned(
        freshness.with_orphan(store, live_paths, analyzer_version).select(*key, "last_seq", "size_bytes", "orphan")
    )
    orphans = judged.where("orphan")
    kept = pinned(judged.where("NOT orphan").drop("orphan").join(orphans.select(*key), key, "left_anti"))
    evicted = retention.retention_plan(kept, budget_bytes)
    return orphans.select(*key, "size_bytes", F.lit("orphan").alias("reason")).unionByName(
        evicted.select(*key, "size_bytes", F.lit("over_budget").alias("reason"))
    )


def full_maintenance(
    store: DataFrame, live_paths: DataFrame, analyzer_version: str, budget_bytes: int,
    entries: DataFrame, now_ms: int, registry_bytes: int,
) -> DataFrame:
    """Q7 in full: the store's rows to delete and the registry's (W6), one list. Registry rows have no shard."""
    hints = registry.registry_retention(entries, now_ms, registry_bytes).select(
        F.lit(None).cast(store.schema["shard_id"].dataType).alias("shard_id"), F.col("name").alias("key"), "size_bytes", "reason"
    )
    return store_maintenance(store, live_paths, analyzer_version, budget_bytes).unionByName(hints)


def store_after(store: DataFrame, deleted: DataFrame, budget_bytes: int) -> DataFrame:
    """Q7: sizes of the shards and of the store once the planned rows are gone."""
    kept = store.join(deleted.select("shard_id", "key"), ["shard_id", "key"], "left_anti")
    return retention.store_rollup(kept, budget_bytes)


def incremental_worklist(
    fingerprints: DataFrame, current: DataFrame, keys: list[str], strict: bool = True
) -> DataFrame:
    """Q8: stored entries to measure again; an unknown check is never re-measured."""
    checked = freshness.stale_measurements(fingerprints, current, strict)
    worst = freshness.worst_freshness(checked, keys)
    return worst.where(F.col("freshness").isin("stale", "gone"))


def revalidation_claims(
    sites: DataFrame, fingerprints: DataFrame, current: DataFrame, keys: list[str], rechecked: DataFrame | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Q8 on a stream of sites: what to measure again while it is looked at, each claimed once."""
    worst = incremental_worklist(fingerprints, current, keys, strict=False)
    return windows.claims_stream(sites, worst, keys, rechecked, delay)


def accuracy_suite(measured: DataFrame, oracle: DataFrame, **checks: DataFrame) -> DataFrame:
    """Q9: benchmarks outside their tolerance."""
    return compare.accuracy_compare(measured, oracle, **checks).where(~F.col("within"))


def remeasure_worklist(
    fingerprints: DataFrame, current_files: DataFrame, stored: DataFrame, installed: DataFrame
) -> DataFrame:
    """Q8 in full: current files are fingerprinted (S9), stored entries whose files changed are
    dropped, and what installed dependencies then lack is measured again (J14).

    `current_files`: path, len, modified_millis, content. `stored`: identity, workspace, name,
    version, import_kind. `installed`: workspace, name, version, has_default.
    """
    current = files.fingerprint_files(current_files)
    stale = incremental_worklist(fingerprints, current.withColumn("readable", F.col("content_hash").isNotNull()), ["identity"])
    held = stored.join(stale.select("identity"), "identity", "left_anti").drop("identity")
    return freshness.measurement_worklist(installed, held)
