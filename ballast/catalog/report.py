"""Workspace report, joins on sites, comparisons, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.adapters import table, view
from ballast.catalog import register
from ballast.catalog.sql import kilo_text, oracle
from ballast.functions import identity as I
from ballast.functions import quality as Q
from ballast.operators import changes, compare, facts, report, resolve
from ballast.session import scratch_path
from ballast.sources import sinks

WORKSPACE = ["workspace"]


def _rows(spark, sf_dir):
    return report.report_rows(view(spark, sf_dir, "sites"), view(spark, sf_dir, "budgets"))


def _identified(spark, sf_dir):
    return view(spark, sf_dir, "sites").withColumn(
        "identity",
        I.import_identity(F.col("specifier"), F.col("import_kind"), F.col("runtime"), F.col("named")),
    )


def _parts(spark, sf_dir):
    return facts.contributions(
        _identified(spark, sf_dir), ["workspace", "source_file", "runtime", "site", "specifier", "identity"]
    )


_ROW_COLUMNS = (
    "workspace, package_name, specifier, source_file, line, runtime, minified_bytes, gzip_bytes, brotli_bytes,"
    " zstd_bytes, shared_bytes, confidence, confidence_reasons, top_modules, warning, is_conservative, over_budget"
)


@register("A1_report_rows", oracle(f"SELECT {_ROW_COLUMNS} FROM rows_", "rows_"))
def a1(spark, sf_dir):
    return _rows(spark, sf_dir).drop("module_contributions")


@register(
    "W1_report_order",
    oracle(
        """SELECT workspace, source_file, line, specifier, brotli_bytes FROM rows_
           ORDER BY brotli_bytes DESC NULLS LAST, source_file || ':' || line || ':' || specifier""",
        "rows_",
    ),
)
def w1(spark, sf_dir):
    ordered = report.report_order(_rows(spark, sf_dir))
    return ordered.select("workspace", "source_file", "line", "specifier", "brotli_bytes")


_SUMMARY = """SELECT workspace, count(*) AS import_count, CAST(coalesce(sum(brotli_bytes), 0) AS BIGINT) AS combined_brotli_bytes,
  count(*) FILTER (WHERE confidence = 'low') AS low_confidence_count, count(*) FILTER (WHERE confidence = 'medium') AS medium_confidence_count,
  count(*) FILTER (WHERE is_conservative) AS conservative_count, count(*) FILTER (WHERE over_budget) AS budget_violation_count
  FROM rows_ GROUP BY workspace"""


@register("A2_report_summary", oracle(_SUMMARY, "rows_"))
def a2(spark, sf_dir):
    return report.report_summary(_rows(spark, sf_dir))


@register(
    "A3_duplicate_imports",
    oracle(
        """SELECT specifier, count(*) AS import_count, CAST(coalesce(sum(brotli_bytes), 0) AS BIGINT) AS combined_brotli_bytes,
           count(DISTINCT source_file) AS file_count FROM sites GROUP BY specifier HAVING count(*) > 1
           ORDER BY import_count DESC, combined_brotli_bytes DESC, specifier""",
        "sites",
    ),
)
def a3(spark, sf_dir):
    return report.order_duplicates(report.duplicate_imports(view(spark, sf_dir, "sites"), []))


@register(
    "A3_duplicate_imports_by_workspace",
    oracle(
        """SELECT workspace, specifier, count(*) AS import_count, CAST(coalesce(sum(brotli_bytes), 0) AS BIGINT) AS combined_brotli_bytes,
           count(DISTINCT source_file) AS file_count FROM sites GROUP BY workspace, specifier HAVING count(*) > 1""",
        "sites",
    ),
)
def a3_workspace(spark, sf_dir):
    return report.duplicate_imports(view(spark, sf_dir, "sites"), WORKSPACE)


@register(
    "A3_duplicate_import_files",
    oracle(
        """SELECT workspace, specifier, source_file, count(*) AS imports_in_file FROM sites
           WHERE (workspace, specifier) IN (SELECT (workspace, specifier) FROM sites GROUP BY workspace, specifier HAVING count(*) > 1)
           GROUP BY workspace, specifier, source_file""",
        "sites",
    ),
)
def a3_files(spark, sf_dir):
    return report.duplicate_import_files(view(spark, sf_dir, "sites"), WORKSPACE)


@register(
    "A4_shared_modules",
    oracle(
        """SELECT module_path, count(*) AS import_count, max(bytes) AS module_bytes, CAST(sum(bytes) AS BIGINT) AS combined_bytes,
           count(DISTINCT specifier) AS specifier_count, split_part(module_path, '/', -1) AS basename,
           (len(string_split(module_path, '/node_modules/')) > 2) AS vendored FROM parts GROUP BY module_path HAVING count(*) > 1""",
        "parts",
    ),
)
def a4(spark, sf_dir):
    return report.shared_modules(_parts(spark, sf_dir), [])


@register(
    "A4_shared_module_specifiers",
    oracle(
        """SELECT DISTINCT workspace, module_path, specifier FROM parts WHERE (workspace, module_path) IN
           (SELECT (workspace, module_path) FROM parts GROUP BY workspace, module_path HAVING count(*) > 1)""",
        "parts",
    ),
)
def a4_specifiers(spark, sf_dir):
    return report.shared_module_specifiers(_parts(spark, sf_dir), WORKSPACE)


_TREEMAP = """SELECT workspace, position, package_name, specifier, source_file, brotli_bytes,
  CASE WHEN total = 0 THEN 0 ELSE (brotli_bytes * 100 + total // 2) // total END AS percentage, confidence FROM
  (SELECT r.*, CAST(t.total AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY r.workspace ORDER BY brotli_bytes DESC,
     source_file || ':' || line || ':' || specifier) AS INTEGER) AS position
   FROM rows_ r JOIN (SELECT workspace, sum(brotli_bytes) AS total FROM rows_ GROUP BY workspace) t ON t.workspace = r.workspace
   WHERE brotli_bytes > 0) WHERE position <= 10"""


@register("A5_treemap_shares", oracle(_TREEMAP, "rows_"))
def a5(spark, sf_dir):
    return report.treemap_shares(_rows(spark, sf_dir))


@register(
    "A6_shared_bytes",
    oracle(
        """SELECT site, CAST(sum(CASE WHEN uses > 1 THEN bytes ELSE 0 END) AS BIGINT) AS shared_bytes FROM
           (SELECT *, count(*) OVER (PARTITION BY workspace, source_file, runtime, module_path) AS uses FROM parts) GROUP BY site""",
        "parts",
    ),
)
def a6(spark, sf_dir):
    return facts.site_shared_bytes(view(spark, sf_dir, "sites"), ["site"])


@register(
    "A7_top_modules",
    oracle(
        """SELECT * FROM (SELECT package_name, module_path, bytes, CAST(row_number() OVER (PARTITION BY package_name
             ORDER BY bytes DESC, module_path) AS INTEGER) AS rank FROM
             (SELECT package_name, module_path, max(bytes) AS bytes FROM parts GROUP BY package_name, module_path)) WHERE rank <= 10""",
        "parts",
    ),
)
def a7(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    modules = facts.contributions(sites, ["package_name"]).groupBy("package_name", "module_path").agg(
        F.max("bytes").alias("bytes")
    )
    return facts.top_modules(modules, ["package_name"])


@register(
    "A18_budget_violation_counts",
    oracle(
        """SELECT i.workspace, imports_over, files_over, files_within, files_not_evaluated FROM
           (SELECT g.workspace, count(*) FILTER (WHERE status = 'ready' AND budgetable AND brotli_bytes > per_import_brotli_bytes) AS imports_over
            FROM graded g LEFT JOIN budgets b ON b.workspace = g.workspace GROUP BY g.workspace) i
           FULL JOIN (SELECT workspace, count(*) FILTER (WHERE v = 'over') AS files_over, count(*) FILTER (WHERE v = 'within') AS files_within,
             count(*) FILTER (WHERE v = 'not_evaluated') AS files_not_evaluated FROM
             (SELECT t.workspace, CASE WHEN per_file_brotli_bytes IS NULL OR incomplete OR shaky THEN 'not_evaluated'
                WHEN brotli > per_file_brotli_bytes THEN 'over' ELSE 'within' END AS v FROM
                (SELECT workspace, source_file, sum(brotli_bytes) AS brotli, bool_or(NOT measured OR coalesce(diag1 = 'uncounted_assets', false)) AS incomplete,
                   bool_or(coalesce(diag1 IN ('asset_io', 'imprecise_assets'), false) OR coalesce(diag2 = 'timeout', false)) AS shaky
                 FROM graded GROUP BY workspace, source_file) t LEFT JOIN budgets b ON b.workspace = t.workspace) GROUP BY workspace) f
           ON f.workspace = i.workspace""",
        "graded", "budgets",
    ),
)
def a18(spark, sf_dir):
    from ballast.operators import budgets

    sites = view(spark, sf_dir, "sites")
    shaky = F.exists("diagnostics", lambda d: d["stage"].isin(V.TRANSIENT_STAGES + V.NON_BUDGETABLE_STAGES))
    stages = sites.groupBy("workspace", "source_file").agg(F.bool_or(shaky).alias("_shaky"))
    totals = facts.fallback_totals(sites, ["workspace", "source_file"])
    costs = (
        totals.join(stages, ["workspace", "source_file"])
        .withColumn("incomplete", F.col("missing_inputs"))
        .withColumn("degraded", F.lit(False))
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn(
            "diagnostics",
            F.when(F.col("_shaky"), F.array(F.struct(F.lit("timeout").alias("stage")))).otherwise(
                F.array().cast("array<struct<stage:string>>")
            ),
        )
    )
    return budgets.violation_counts(sites, costs, view(spark, sf_dir, "budgets"))


@register(
    "A23_duplicate_site_count",
    oracle(
        "SELECT workspace, count(*) AS sites, count(DISTINCT source_file) AS distinct_files FROM sites GROUP BY workspace",
        "sites",
    ),
)
def a23(spark, sf_dir):
    return report.site_counts(view(spark, sf_dir, "sites"), WORKSPACE)


@register(
    "A23_sketched_file_counts",
    oracle("SELECT workspace, count(DISTINCT source_file) AS distinct_files, true AS within FROM sites GROUP BY workspace", "sites"),
)
def a23_sketched(spark, sf_dir):
    """A sketch for each day, united over the days, against the exact count."""
    sites = view(spark, sf_dir, "sites").withColumn("day", F.expr("ts_ms div 86400000"))
    united = report.united_files(report.file_sketches(sites, [*WORKSPACE, "day"]), WORKSPACE)
    exact = report.site_counts(sites, WORKSPACE).select(*WORKSPACE, "distinct_files")
    # four standard errors
    near = F.abs(F.col("estimated_files") - F.col("distinct_files")) <= 4 * report.SKETCH_ERROR * F.col("distinct_files") + 1
    return exact.join(united, WORKSPACE).select(*WORKSPACE, "distinct_files", near.alias("within"))


# ---- joins ------------------------------------------------------------------
_HOLDERS = (
    "CASE l_partkey % 3 WHEN 0 THEN '/repo/w' || (l_orderkey % 20)"
    " WHEN 1 THEN '/repo/w' || (l_orderkey % 20) || '/src' ELSE '/repo/w' || (l_orderkey % 20) || '/src/d' || (l_orderkey % 9) END"
)
COPIES_SQL = f"""SELECT workspace, dir, package_name, max(version) AS version FROM (SELECT 'w' || (l_orderkey % 20) AS workspace, {_HOLDERS} AS dir,
  '@s' || (l_suppkey % 7) || '/p' || (l_partkey % 200) AS package_name, '1.' || (l_partkey % 7) AS version
  FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY workspace, dir, package_name"""


def installed_copies(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").selectExpr(
        "'w' || (l_orderkey % 20) AS workspace",
        f"{_HOLDERS} AS dir",
        "'@s' || (l_suppkey % 7) || '/p' || (l_partkey % 200) AS package_name",
        "'1.' || (l_partkey % 7) AS version",
    )


@register(
    "J1_resolve_installed",
    oracle(
        """SELECT s.site, max(c.dir) AS installed_dir, arg_max(c.version, length(c.dir)) AS installed_version,
             CASE WHEN max(c.dir) IS NULL THEN 'missing' ELSE 'installed' END AS resolution
           FROM sites s LEFT JOIN copies c ON c.workspace = s.workspace AND c.package_name = s.package_name
             AND starts_with(s.source_file, c.dir || '/') GROUP BY s.site""",
        "sites",
        copies=COPIES_SQL,
    ),
)
def j1(spark, sf_dir):
    sites = view(spark, sf_dir, "sites").withColumn("path", F.col("source_file"))
    found = resolve.resolve_installed(sites, installed_copies(spark, sf_dir))
    return found.select("site", "installed_dir", "installed_version", "resolution").distinct()


_RULE_DIRS = """SELECT DISTINCT 'w' || (o_orderkey % 20) AS workspace, CASE o_custkey % 3 WHEN 0 THEN '/repo/w' || (o_orderkey % 20)
  WHEN 1 THEN '/repo/w' || (o_orderkey % 20) || '/src/d' || (o_custkey % 9) ELSE '/elsewhere' END AS dir FROM orders"""


@register(
    "J2_nearest_ignore_rules",
    oracle(
        """SELECT f.workspace, f.path, max(r.dir) AS rule_dir FROM (SELECT DISTINCT workspace, source_file AS path FROM sites) f
           LEFT JOIN dirs r ON r.workspace = f.workspace AND starts_with(f.path, r.dir || '/') GROUP BY f.workspace, f.path""",
        "sites",
        dirs=_RULE_DIRS,
    ),
)
def j2(spark, sf_dir):
    files = view(spark, sf_dir, "sites").select("workspace", F.col("source_file").alias("path")).distinct()
    rules = table(spark, sf_dir, "orders").selectExpr(
        "'w' || (o_orderkey % 20) AS workspace",
        "CASE o_custkey % 3 WHEN 0 THEN '/repo/w' || (o_orderkey % 20)"
        " WHEN 1 THEN '/repo/w' || (o_orderkey % 20) || '/src/d' || (o_custkey % 9) ELSE '/elsewhere' END AS dir",
    )
    return resolve.nearest_ignore_rules(files, rules)


_STORED = """SELECT specifier, import_kind, runtime, names, max(brotli_bytes) AS stored_brotli FROM graded
  WHERE n1 <> 'n3' GROUP BY specifier, import_kind, runtime, names"""


@register(
    "J3_attach_measurements",
    oracle(
        """SELECT site, CASE WHEN g.status = 'missing' THEN 'missing' WHEN m.specifier IS NULL THEN 'loading' ELSE 'ready' END AS status, stored_brotli
           FROM graded g LEFT JOIN stored m ON g.specifier = m.specifier AND g.import_kind = m.import_kind AND g.runtime = m.runtime AND g.names = m.names""",
        "graded",
        stored=_STORED,
    ),
)
def j3(spark, sf_dir):
    sites = view(spark, sf_dir, "sites").withColumn("names", F.array_join("named", ","))
    stored = sites.where("n1 <> 'n3'").groupBy(*facts.IDENTITY).agg(
        F.max("brotli_bytes").alias("stored_brotli")
    )
    asked = sites.select("site", *facts.IDENTITY, F.col("status").alias("resolution"))
    joined = facts.attach_measurements(asked, stored.withColumn("unmeasured_stage", F.lit(None).cast("string")))
    return joined.select("site", "status", "stored_brotli")


_CHANGED_SQL = "SELECT DISTINCT '/repo/w' || (o_orderkey % 20) || '/src/d' || (o_orderkey % 9) || '/f' || o_orderkey || '.ts' AS source_file, o_custkey % 24 AS line FROM orders"


def _changed(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "'/repo/w' || (o_orderkey % 20) || '/src/d' || (o_orderkey % 9) || '/f' || o_orderkey || '.ts' AS source_file",
        "o_custkey % 24 AS line",
    )


@register(
    "J6_changed_imports",
    oracle(
        """SELECT site, brotli_bytes FROM sites s WHERE EXISTS (SELECT 1 FROM changed c WHERE c.source_file = s.source_file
           AND c.line BETWEEN s.stmt_start_line AND s.stmt_end_line)""",
        "sites",
        changed=_CHANGED_SQL,
    ),
)
def j6(spark, sf_dir):
    hit = changes.changed_imports(view(spark, sf_dir, "sites"), _changed(spark, sf_dir), ["source_file"])
    return hit.select("site", "brotli_bytes")


_ASKED = "SELECT DISTINCT '@s' || (p_partkey % 8) || '/p' || (p_partkey % 210) AS specifier, 'c' || (p_partkey % 6) AS comparison FROM part"
_ANALYSED = """SELECT 'c' || (line % 6) AS comparison, specifier, max(CASE WHEN measured THEN brotli_bytes END) AS brotli_bytes,
  bool_or(has_result) AS has_result, max(error) AS error FROM graded GROUP BY 1, 2"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "'c' || (p_partkey % 6) AS comparison", "'@s' || (p_partkey % 8) || '/p' || (p_partkey % 210) AS specifier"
    ).distinct()


def _analysed(spark, sf_dir):
    sites = view(spark, sf_dir, "sites").withColumn("comparison", F.expr("'c' || (line % 6)"))
    size = F.max(F.when(Q.is_measured(), F.col("brotli_bytes")))
    return sites.groupBy("comparison", "specifier").agg(
        *[size.alias(name) for name in V.SIZES],
        F.bool_or("has_result").alias("has_result"),
        F.max("error").alias("error"),
        F.lit(None).cast("string").alias("message"),
    )


_COMPARED = """SELECT comparison, specifier, 'compared' AS outcome, CAST(row_number() OVER (PARTITION BY comparison ORDER BY brotli_bytes, specifier) AS INTEGER) AS position,
    brotli_bytes, CAST(NULL AS VARCHAR) AS reason FROM analysed WHERE brotli_bytes IS NOT NULL
  UNION ALL SELECT comparison, specifier, 'unsized', NULL, NULL, CASE WHEN NOT has_result THEN 'no result for this import'
    ELSE coalesce(error, 'no size was produced for this import') END FROM analysed WHERE brotli_bytes IS NULL
  UNION ALL SELECT comparison, specifier, 'not_analysed', NULL, NULL, 'not a package import that can be sized' FROM asked a
    WHERE NOT EXISTS (SELECT 1 FROM analysed b WHERE b.comparison = a.comparison AND b.specifier = a.specifier)"""
_PAIR = ["comparison", "specifier"]


@register("J8_compare_imports", oracle(_COMPARED, "graded", asked=_ASKED, analysed=_ANALYSED))
def j8(spark, sf_dir):
    return compare.compare_imports(_asked(spark, sf_dir), _analysed(spark, sf_dir), _PAIR)


@register(
    "Q5_compare",
    oracle(
        f"""SELECT comparison, count(*) FILTER (WHERE outcome = 'compared') AS compared_count,
            count(*) FILTER (WHERE outcome <> 'compared') AS excluded_count FROM ({_COMPARED}) GROUP BY comparison""",
        "graded", asked=_ASKED, analysed=_ANALYSED,
    ),
)
def q5(spark, sf_dir):
    from ballast.plans import jobs

    compared = jobs.comparison(_asked(spark, sf_dir), _analysed(spark, sf_dir), _PAIR)
    return compare.comparison_counts(compared, ["comparison"])


@register(
    "Q5_compare_rows",
    oracle(f"SELECT * FROM ({_COMPARED}) ORDER BY comparison, position NULLS LAST, specifier", "graded", asked=_ASKED, analysed=_ANALYSED),
)
def q5_rows(spark, sf_dir):
    from ballast.plans import jobs

    return jobs.comparison(_asked(spark, sf_dir), _analysed(spark, sf_dir), _PAIR)


@register(
    "W11_import_rank",
    oracle(
        """SELECT comparison, specifier, CAST(row_number() OVER (PARTITION BY comparison ORDER BY brotli_bytes, specifier) AS INTEGER) AS position
           FROM analysed WHERE brotli_bytes IS NOT NULL""",
        "graded", analysed=_ANALYSED,
    ),
)
def w11(spark, sf_dir):
    measured = _analysed(spark, sf_dir).where(Q.is_measured())
    return compare.import_rank(measured, ["comparison"], "specifier").select(*_PAIR, "position")


@register(
    "U3_not_analysed",
    oracle("SELECT comparison, specifier FROM asked EXCEPT SELECT comparison, specifier FROM analysed", "graded", asked=_ASKED, analysed=_ANALYSED),
)
def u3(spark, sf_dir):
    return compare.not_analysed(_asked(spark, sf_dir), _analysed(spark, sf_dir), _PAIR)


@register(
    "J9_substitutions",
    oracle(
        """SELECT id, position, suggestion FROM (SELECT id, specifier, CASE WHEN starts_with(specifier, '@') AND contains(specifier, '/')
             THEN split_part(specifier, '/', 1) || '/' || split_part(specifier, '/', 2) ELSE split_part(specifier, '/', 1) END AS package_name FROM specs) s
           JOIN (VALUES ('moment', 1, 'dayjs'), ('moment', 2, 'date-fns'), ('lodash', 1, 'lodash-es'), ('uuid/v4', 1, 'uuid')) t(wanted, position, suggestion)
           ON t.wanted = CASE WHEN specifier IN ('moment', 'lodash', 'uuid/v4') THEN specifier ELSE package_name END""",
        "specs",
    ),
)
def j9(spark, sf_dir):
    from ballast.functions import specifiers as S

    sites = view(spark, sf_dir, "specs").withColumn("package_name", S.package_name(F.col("specifier")))
    found = compare.substitutions(sites, compare.substitution_table(spark))
    return found.select("id", "position", "suggestion")


_PART_IDS = "SELECT *, specifier || '|' || import_kind || '|' || runtime || '|' || names AS identity FROM parts"


@register(
    "J10_module_sharers",
    oracle(
        """SELECT workspace, source_file, runtime, specifier, import_kind, names, module_path, bytes, position, other_imports FROM (
             SELECT *, CAST(row_number() OVER (PARTITION BY workspace, source_file, identity ORDER BY bytes DESC, module_path) AS INTEGER) AS position FROM (
               SELECT u.workspace, u.source_file, u.runtime, u.identity, any_value(specifier) AS specifier, any_value(import_kind) AS import_kind,
                 any_value(names) AS names, u.module_path, max(bytes) AS bytes, any_value(n) - 1 AS other_imports
               FROM used u JOIN (SELECT workspace, source_file, runtime, module_path, count(DISTINCT identity) AS n FROM used GROUP BY ALL) c
                 ON c.workspace = u.workspace AND c.source_file = u.source_file AND c.runtime = u.runtime AND c.module_path = u.module_path
               WHERE n > 1 GROUP BY u.workspace, u.source_file, u.runtime, u.identity, u.module_path)) WHERE position <= 3""",
        "parts",
        used=_PART_IDS,
    ),
)
def j10(spark, sf_dir):
    found = changes.site_shared_with(_identified(spark, sf_dir))
    fields = F.split("identity", "\u0000")
    return found.select(
        "workspace",
        "source_file",
        "runtime",
        fields[0].alias("specifier"),
        fields[1].alias("import_kind"),
        F.replace(F.coalesce(F.get(fields, 3), F.lit("")), F.lit("\u0001"), F.lit(",")).alias("names"),
        "module_path",
        "bytes",
        "position",
        "other_imports",
    )


_MEASURED_LABELS = "SELECT 'b' || p_partkey AS label, CAST(floor(p_retailprice) AS BIGINT) AS brotli_bytes, CAST(floor(p_retailprice) AS BIGINT) * 3 AS minified_bytes FROM part"
_ORACLE_LABELS = """SELECT 'b' || p_partkey AS label, CAST(floor(p_retailprice) AS BIGINT) + p_size * 20 AS brotli_bytes,
  CAST(floor(p_retailprice) AS BIGINT) * 3 + p_size AS minified_bytes, CASE WHEN p_size % 4 = 0 THEN 0.5 END AS tolerance,
  CASE WHEN p_size % 3 = 0 THEN 0.01 END AS minified_tolerance FROM part"""
_WITHIN = """SELECT m.label, abs(m.brotli_bytes - o.brotli_bytes) / greatest(o.brotli_bytes, 1)::DOUBLE <= coalesce(tolerance, 0.25)
    AND (minified_tolerance IS NULL OR abs(m.minified_bytes - o.minified_bytes) / greatest(o.minified_bytes, 1)::DOUBLE <= minified_tolerance)
    AND (p_size % 10 <> 7 OR (p_partkey % 4 = 1 AND p_partkey % 2 = 1)) AND NOT (p_partkey % 30 = 0 AND p_size % 2 = 0) AS within
  FROM measured m JOIN other o ON o.label = m.label JOIN part ON 'b' || p_partkey = m.label"""


def _accuracy(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = "CAST(floor(p_retailprice) AS BIGINT)"
    measured = part.selectExpr("'b' || p_partkey AS label", f"{own} AS brotli_bytes", f"{own} * 3 AS minified_bytes")
    other = part.selectExpr(
        "'b' || p_partkey AS label",
        f"{own} + p_size * 20 AS brotli_bytes",
        f"{own} * 3 + p_size AS minified_bytes",
        "CAST(CASE WHEN p_size % 4 = 0 THEN 0.5 END AS DOUBLE) AS tolerance",
        "CAST(CASE WHEN p_size % 3 = 0 THEN 0.01 END AS DOUBLE) AS minified_tolerance",
    )
    # every odd benchmark ships one font of 5 bytes, or of 6 where the key is 3 mod 4
    assets = part.where("p_partkey % 2 = 1").selectExpr(
        "'b' || p_partkey AS label", "'font' AS kind", "CAST(CASE WHEN p_partkey % 4 = 1 THEN 5 ELSE 6 END AS BIGINT) AS raw_bytes"
    )
    expected = part.where("p_size % 10 = 7").selectExpr(
        "'b' || p_partkey AS label", "'font' AS kind", "CAST(5 AS BIGINT) AS bytes"
    )
    excluded = part.where("p_partkey % 30 = 0").selectExpr("'b' || p_partkey AS label", "'/secret.js' AS excluded_module")
    modules = part.selectExpr(
        "'b' || p_partkey AS label", "CASE WHEN p_size % 2 = 0 THEN '/a\\\\secret.js' ELSE '/a/open.js' END AS path"
    )
    return measured, other, dict(assets=assets, expected_assets=expected, excluded=excluded, modules=modules)


@register("J11_accuracy_compare", oracle(_WITHIN, measured=_MEASURED_LABELS, other=_ORACLE_LABELS))
def j11(spark, sf_dir):
    measured, other, checks = _accuracy(spark, sf_dir)
    return compare.accuracy_compare(measured, other, **checks).select("label", "within")


@register("Q9_accuracy_suite", oracle(f"SELECT label FROM ({_WITHIN}) WHERE NOT within", measured=_MEASURED_LABELS, other=_ORACLE_LABELS))
def q9(spark, sf_dir):
    from ballast.plans import jobs

    measured, other, checks = _accuracy(spark, sf_dir)
    return jobs.accuracy_suite(measured, other, **checks).select("label")


_DOCS = "SELECT DISTINCT workspace, specifier FROM sites"


@register(
    "J12_merge_refreshed",
    oracle(
        """SELECT site, CASE WHEN taken THEN u.brotli_bytes ELSE s.brotli_bytes END AS brotli_bytes, CASE WHEN taken THEN u.error ELSE s.error END AS error,
             CASE WHEN taken THEN 'ready' ELSE s.status END AS status, taken AS changed FROM
           (SELECT g.*, u.k IS NOT NULL AND NOT (u.error IS NOT NULL AND g.has_result) AS taken FROM graded g
              LEFT JOIN updates u ON u.k = g.site) s LEFT JOIN updates u ON u.k = s.site""",
        "graded",
        updates="""SELECT site AS k, CASE WHEN stmt_end_line % 3 <> 0 THEN gzip_bytes END AS brotli_bytes,
            CASE WHEN stmt_end_line % 3 = 0 THEN 'failed again' END AS error FROM graded WHERE line % 2 = 0""",
    ),
)
def j12(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    updates = sites.where("line % 2 = 0").selectExpr(
        "site",
        "CASE WHEN stmt_end_line % 3 <> 0 THEN gzip_bytes END AS brotli_bytes",
        "CASE WHEN stmt_end_line % 3 = 0 THEN 'failed again' END AS error",
    )
    existing = sites.select("site", "brotli_bytes", "error", "status", "has_result")
    return changes.merge_refreshed(existing, updates, ["site"]).select(
        "site", "brotli_bytes", "error", "status", "changed"
    )


# in a third of the files one result has no identity, so these files are merged by specifier
@register(
    "J12_merge_by_document",
    oracle(
        """SELECT site, CASE WHEN taken THEN new_brotli ELSE brotli_bytes END AS brotli_bytes, CASE WHEN taken THEN new_error ELSE error END AS error,
             CASE WHEN taken THEN 'ready' ELSE status END AS status, CASE WHEN NOT taken THEN insights END AS insights, taken AS changed FROM
           (SELECT x.*, u.brotli_bytes AS new_brotli, u.error AS new_error, u.k IS NOT NULL AND NOT (u.error IS NOT NULL AND x.has_result) AS taken
            FROM (SELECT g.*, 'i' || line AS insights, CASE WHEN a.aligned THEN site ELSE specifier END AS k FROM graded g LEFT JOIN aligned a USING (workspace, source_file)) x
            LEFT JOIN latest u ON u.workspace = x.workspace AND u.source_file = x.source_file AND u.k = x.k)""",
        "graded",
        pushed="""SELECT workspace, source_file, line AS position, specifier, CASE WHEN stmt_end_line % 3 <> 0 THEN gzip_bytes END AS brotli_bytes,
            CASE WHEN stmt_end_line % 3 = 0 THEN 'failed again' END AS error,
            CASE WHEN CAST(regexp_extract(source_file, '/f([0-9]+)', 1) AS BIGINT) % 3 = 0 AND line = 2 THEN NULL ELSE site END AS identity FROM graded WHERE line % 2 = 0""",
        aligned="SELECT workspace, source_file, count(*) FILTER (WHERE identity IS NULL) = 0 AS aligned FROM pushed GROUP BY ALL",
        latest="""SELECT workspace, source_file, CASE WHEN aligned THEN identity ELSE specifier END AS k, brotli_bytes, error FROM pushed JOIN aligned USING (workspace, source_file)
            QUALIFY row_number() OVER (PARTITION BY workspace, source_file, CASE WHEN aligned THEN identity ELSE specifier END ORDER BY position DESC) = 1""",
    ),
)
def j12_documents(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    updates = sites.where("line % 2 = 0").selectExpr(
        "workspace", "source_file", "line AS position", "specifier",
        "CASE WHEN CAST(regexp_extract(source_file, '/f([0-9]+)', 1) AS BIGINT) % 3 = 0 AND line = 2 THEN NULL ELSE site END AS identity",
        "CASE WHEN stmt_end_line % 3 <> 0 THEN gzip_bytes END AS brotli_bytes", "CASE WHEN stmt_end_line % 3 = 0 THEN 'failed again' END AS error",
    )
    existing = sites.selectExpr(
        "workspace", "source_file", "site AS identity", "specifier", "site", "brotli_bytes", "error", "status", "has_result", "'i' || line AS insights"
    )
    return changes.merge_refreshed_documents(existing, updates, ["workspace", "source_file"], "position").select(
        "site", "brotli_bytes", "error", "status", "insights", "changed"
    )


@register(
    "U1_union_ready_and_pending",
    oracle("SELECT site, line, status, brotli_bytes FROM sites ORDER BY site, line", "sites"),
)
def u1(spark, sf_dir):
    sites = view(spark, sf_dir, "sites").select("site", "line", "status", "brotli_bytes")
    ready, pending = sites.where("status = 'ready'"), sites.where("status <> 'ready'")
    return ready.unionByName(pending).orderBy("site", "line")


@register(
    "U4_dedupe_targets",
    oracle("SELECT workspace, source_file FROM sites GROUP BY workspace, source_file", "sites"),
)
def u4(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("workspace", "source_file").dropDuplicates()


_SHARED_TEXT = """SELECT site, string_agg(name, ', ' ORDER BY position) AS shared_text FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY bytes DESC, module_path) AS position FROM (
    SELECT u.site, u.module_path, split_part(u.module_path, '/', -1) AS name, max(u.bytes) AS bytes
    FROM used u JOIN (SELECT workspace, source_file, runtime, module_path, count(DISTINCT site) AS n FROM used GROUP BY ALL) c
      ON c.workspace = u.workspace AND c.source_file = u.source_file AND c.runtime = u.runtime AND c.module_path = u.module_path
    WHERE n > 1 GROUP BY u.site, u.module_path)) WHERE position <= 3 GROUP BY site"""


@register(
    "A20_insights",
    oracle(
        f"""SELECT site, concat_ws(' | ', CASE WHEN hit THEN 'changed: +' || size || ' br' END, CASE WHEN over THEN 'over budget: ' || size || ' br' END,
             CASE WHEN shared_bytes > 0 THEN 'shared: ' || coalesce(shared_text, 'outside the module breakdown') || '; ' || shared_size END,
             CASE WHEN syntax = 'star_reexport' THEN 'barrel' END,
             CASE WHEN durable AND delta <> 0 THEN 'history: ' || CASE WHEN delta > 0 THEN '+' ELSE '-' END || delta_size ||
               CASE WHEN imprecise OR previous_imprecise THEN ', against an upper bound' ELSE '' END END) AS insights
           FROM (SELECT g.*, t.shared_text, {kilo_text('g.brotli_bytes')} AS size, {kilo_text('g.shared_bytes')} AS shared_size,
             coalesce(budgetable AND brotli_bytes > per_import_brotli_bytes, false) AS over, g.brotli_bytes - previous_brotli AS delta,
             {kilo_text('abs(g.brotli_bytes - previous_brotli)')} AS delta_size, coalesce(previous_imprecise, false) AS previous_imprecise,
             EXISTS (SELECT 1 FROM changed c WHERE c.source_file = g.source_file AND c.line BETWEEN g.stmt_start_line AND g.stmt_end_line) AS hit
             FROM graded g LEFT JOIN budgets b ON b.workspace = g.workspace LEFT JOIN shared t ON t.site = g.site
             LEFT JOIN (SELECT site AS k, max(gzip_bytes) - 7000 AS previous_brotli, bool_or(line % 5 = 0) AS previous_imprecise FROM graded WHERE stmt_end_line % 2 = 0 GROUP BY site) p ON p.k = g.site
             WHERE g.status = 'ready' AND measured)
           WHERE hit OR over OR shared_bytes > 0 OR syntax = 'star_reexport' OR (durable AND delta <> 0)""",
        "graded", "budgets", "parts",
        changed=_CHANGED_SQL, used="SELECT * FROM parts", shared=_SHARED_TEXT,
    ),
)
def a20(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    previous = sites.where("stmt_end_line % 2 = 0").groupBy("site").agg(
        (F.max("gzip_bytes") - 7000).alias("previous_brotli_bytes"),
        F.bool_or(F.col("line") % 5 == 0).alias("previous_imprecise"),
    )
    named = sites.withColumn("identity", F.col("site"))
    shared = changes.shared_text(changes.site_shared_with(named), ["identity"]).withColumnRenamed("identity", "site")
    # other sites have no insights
    asked = sites.where((F.col("status") == "ready") & Q.is_measured())
    hit = changes.changed_imports(asked, _changed(spark, sf_dir), ["source_file"])
    found = changes.insights(sites, hit, shared, view(spark, sf_dir, "budgets"), previous, "site")
    return found.select("site", F.array_join("insights", " | ").alias("insights"))


@register("S10_write_report", oracle(_SUMMARY, "rows_"))
def s10(spark, sf_dir):
    paths = sinks.write_report(_rows(spark, sf_dir), scratch_path(spark, "report"))
    return spark.read.parquet(paths["summary"])


@register(
    "S10_report_tables",
    oracle(
        f"""SELECT 'rows' AS report_table, count(*) AS n, CAST(sum(coalesce(brotli_bytes, 0)) AS BIGINT) AS mark FROM rows_
            UNION ALL SELECT 'summary', count(*), CAST(sum(hash_free) AS BIGINT) FROM (SELECT *, 1 AS hash_free FROM ({_SUMMARY}))
            UNION ALL SELECT 'duplicates', count(*), CAST(sum(import_count + file_count + combined) AS BIGINT) FROM
              (SELECT count(*) AS import_count, count(DISTINCT source_file) AS file_count, coalesce(sum(brotli_bytes), 0) AS combined FROM rows_ GROUP BY workspace, specifier HAVING count(*) > 1)
            UNION ALL SELECT 'duplicate_files', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM rows_
              WHERE (workspace, specifier) IN (SELECT (workspace, specifier) FROM rows_ GROUP BY workspace, specifier HAVING count(*) > 1) GROUP BY workspace, specifier, source_file)
            UNION ALL SELECT 'shared_modules', count(*), CAST(sum(combined + import_count) AS BIGINT) FROM
              (SELECT count(*) AS import_count, sum(bytes) AS combined FROM module_rows GROUP BY workspace, module_path HAVING count(*) > 1)
            UNION ALL SELECT 'shared_module_specifiers', count(*), CAST(sum(length(module_path)) AS BIGINT) FROM (SELECT DISTINCT workspace, module_path, specifier FROM module_rows
              WHERE (workspace, module_path) IN (SELECT (workspace, module_path) FROM module_rows GROUP BY workspace, module_path HAVING count(*) > 1))
            UNION ALL SELECT 'treemap', count(*), CAST(sum(brotli_bytes + percentage) AS BIGINT) FROM ({_TREEMAP})""",
        "rows_", "parts",
        module_rows="SELECT workspace, specifier, module_path, bytes FROM parts WHERE has_result",
    ),
)
def s10_tables(spark, sf_dir):
    """All seven tables, read back from where they were written: rows and a sum over what they say."""
    paths = sinks.write_report(_rows(spark, sf_dir), scratch_path(spark, "report"))
    marks = {
        "rows": F.coalesce("brotli_bytes", F.lit(0)), "summary": F.lit(1),
        "duplicates": F.col("import_count") + F.col("file_count") + F.col("combined_brotli_bytes"), "duplicate_files": F.col("imports_in_file"),
        "shared_modules": F.col("combined_bytes") + F.col("import_count"), "shared_module_specifiers": F.length("module_path"),
        "treemap": F.col("brotli_bytes") + F.col("percentage"),
    }
    counted = [
        spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).cast("long").alias("mark")).withColumn("report_table", F.lit(name))
        for name, mark in marks.items()
    ]
    whole = counted[0]
    for part in counted[1:]:
        whole = whole.unionByName(part)
    return whole.select("report_table", "n", "mark")
