"""Source text, rule files, logs, configuration, diffs, and the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.adapters import table, view
from ballast.catalog import register
from ballast.catalog.sql import oracle
from ballast.operators import changes, ranges, report
from ballast.plans import jobs
from ballast.session import scratch_path
from ballast.sources import files, script, sinks, text

_PATH = (
    "CASE l_linenumber WHEN 1 THEN 'src/f' || l_orderkey || '.TSX' WHEN 2 THEN 'src/node_modules/p/f' || l_orderkey || '.ts'"
    " WHEN 3 THEN 'dist/f' || l_orderkey || '.js' WHEN 4 THEN 'a/b/c/f' || l_orderkey || '.vue' WHEN 5 THEN 'src/f' || l_orderkey || '.mjs'"
    " WHEN 6 THEN 'distant/f' || l_orderkey || '.cts' ELSE 'src/coverage.ts' END"
)


@register(
    "S1_scan_sources",
    f"""SELECT workspace, path FROM (SELECT 'w' || (l_orderkey % 20) AS workspace, l_linenumber AS n, {_PATH} AS path FROM lineitem)
        WHERE n NOT IN (2, 3, 5) ORDER BY workspace, path""",
)
def s1(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").selectExpr("'w' || (l_orderkey % 20) AS workspace", f"{_PATH} AS path")
    return files.scan_sources(listed).orderBy("workspace", "path")


@register(
    "S1_source_tree",
    """SELECT 'source=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
       FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND source <> (SELECT max(source) FROM documents) GROUP BY source""",
)
def s1_tree(spark, sf_dir):
    """The documents as a tree of files, a folder a source, read back without the last folder."""
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("source", "text")
    root = scratch_path(spark, "tree")
    documents.write.partitionBy("source").text(root)
    last = documents.agg(F.max("source")).first()[0]
    tree = files.read_source_tree(spark, root, ["txt"], [f"source={last}"])
    # the writer ends every row with a line end of its own
    return tree.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.sum("len").alias("bytes"), F.sum(F.length(F.regexp_replace("content", "[^\n]", ""))).cast("long").alias("lines")
    )


@register(
    "S2_script_regions",
    r"""SELECT page_id, 'component' AS runtime, 'js' AS lang, body AS text, CAST(length(split_part(html, body, 1)) AS BIGINT) AS "offset",
        CAST(length(split_part(html, body, 1)) - length(replace(split_part(html, body, 1), chr(10), '')) AS BIGINT) AS first_line
        FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script[^>]*>', 1)) AS body FROM pages)""",
)
def s2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "'p' || page_id || '.vue' AS path", "html AS content")
    return script.script_regions(pages).select("page_id", "runtime", "lang", "text", "offset", "first_line")


def _spec(key: str) -> str:
    return f"CASE WHEN l_suppkey % 10 = 0 THEN './local' ELSE '@s' || (l_suppkey % 7) || '/p' || ({key} % 40) END"


_N1, _N2 = "'n' || (l_partkey % 5)", "'n' || (l_suppkey % 5)"


def _statement(form: str, spec: str) -> str:
    """The text of one statement by its form; form 2 is four lines long."""
    return (
        f"CASE {form} WHEN 0 THEN 'import D from \"' || {spec} || '\"' WHEN 1 THEN 'import * as ns from \"' || {spec} || '\";'"
        f" WHEN 2 THEN 'import {{' || chr(10) || '  ' || {_N1} || ', // first' || chr(10) || '  type T, ' || {_N2} || ' as z' || chr(10) || '}} from \"' || {spec} || '\";'"
        f" WHEN 3 THEN 'import type {{ T }} from \"' || {spec} || '\";' WHEN 4 THEN 'export * from \"' || {spec} || '\";'"
        f" WHEN 5 THEN 'export {{ ' || {_N1} || ' as q }} from \"' || {spec} || '\";' WHEN 6 THEN 'const l = await import(\"' || {spec} || '\");'"
        f" WHEN 7 THEN '// import x from \"' || {spec} || '\"' WHEN 8 THEN 'import D, {{ ' || {_N1} || ' }} from \"' || {spec} || '\";'"
        f" ELSE 'import \"' || {spec} || '\"; /* import y from \"z\" */' END"
    )


# a file per line item: a comment, one statement, a string, a second statement
_FORMS = [("l_partkey % 10", "l_partkey"), ("(l_suppkey + l_linenumber) % 10", "(l_partkey + 3)")]
_FILE = (
    "'src/d' || (l_orderkey % 9) || '/f' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'"
    " || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) || '.ts'"
)
_CONTENT = (
    f"'// import a from \"comment\"' || chr(10) || {_statement(_FORMS[0][0], _spec(_FORMS[0][1]))} || chr(10)"
    f" || 'const s = \"import b from c\";' || chr(10) || {_statement(_FORMS[1][0], _spec(_FORMS[1][1]))}"
)

_STATEMENTS_SQL = " UNION ALL ".join(
    f"""SELECT 'w' || (l_orderkey % 20) AS workspace, {_FILE} AS path, {_spec(key)} AS specifier, {_N1} AS n1, {_N2} AS n2, {form} AS form,
      {start} AS start, CASE WHEN {form} = 2 THEN 4 ELSE 1 END AS lines, l_suppkey % 7 AS sk, {key} % 40 AS pk FROM lineitem"""
    for (form, key), start in zip(_FORMS, ("1", f"CASE WHEN {_FORMS[0][0]} = 2 THEN 6 ELSE 3 END"))
)
_FOUND_SQL = """SELECT workspace, path, CAST(start AS BIGINT) AS line, CAST(start + lines - 1 AS BIGINT) AS stmt_end_line, specifier, import_kind, syntax, named, sk, pk FROM (
  SELECT *, 'default' AS import_kind, 'static' AS syntax, '' AS named FROM statements WHERE form IN (0, 8)
  UNION ALL SELECT *, 'namespace', CASE WHEN form = 4 THEN 'star_reexport' ELSE 'static' END, '' FROM statements WHERE form IN (1, 4, 9)
  UNION ALL SELECT *, 'named', CASE WHEN form = 5 THEN 'reexport' ELSE 'static' END,
    CASE WHEN form <> 2 OR n1 = n2 THEN n1 ELSE least(n1, n2) || ',' || greatest(n1, n2) END FROM statements WHERE form IN (2, 5, 8)
  UNION ALL SELECT *, 'dynamic', 'dynamic', '' FROM statements WHERE form = 6) WHERE specifier <> './local'"""


def _sources(spark, sf_dir):
    """Source files made from the line items, one file per row."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'w' || (l_orderkey % 20) AS workspace", f"{_FILE} AS path", f"{_CONTENT} AS content"
    )


@register(
    "S3_extract_imports",
    oracle(
        "SELECT workspace, path, line, stmt_end_line, specifier, import_kind, syntax, named FROM found",
        statements=_STATEMENTS_SQL, found=_FOUND_SQL,
    ),
)
def s3(spark, sf_dir):
    sites = script.extract_imports(script.script_regions(_sources(spark, sf_dir)))
    return sites.select(
        "workspace", "path", "line", "stmt_end_line", "specifier", "import_kind", "syntax", F.array_join("named", ",").alias("named")
    )


# syntax that hides statements from a search for their words: quotes in regular expressions, divisions,
# nested templates, conditions before a regular expression, and strings as binding names
_HARD = [
    ("const q = /[\"'`]/;\nimport {SPEC} from \"{S}\";", 1, "default", "static", ""),
    ("const d = x / 2; const e = (d) / 3;\nif (x) /'/.test(d);\nimport * as n from '{S}' // '", 2, "namespace", "static", ""),
    ("const t = `a ${ b ? `n ${ {k: `}`}.k } '` : \"}\" } import no from \"no\"`;\nexport { k as \"a-b\" } from \"{S}\";", 1, "named", "reexport", "k"),
    ("/* ' */ import { \"string name\" as sn, type T, zz } from \"{S}\"; const r = /import b from \"no\"/g;", 0, "named", "static", "string name,zz"),
    ("o.import(\"no\"); const p = s[0] / 2 / 1;\n\nconst u = `import(\"no\")`; import(`{S}`);", 2, "dynamic", "dynamic", ""),
]


def _hard_text(template: str) -> str:
    quoted = template.replace("'", "' || chr(39) || '").replace("{SPEC}", "D").replace("\n", "' || chr(10) || '").replace("{S}", "' || spec || '")
    return f"'{quoted}'"


_HARD_CASES = " ".join(f"WHEN {n} THEN {_hard_text(case[0])}" for n, case in enumerate(_HARD))
_HARD_ROWS = ", ".join(f"({n}, {line}, '{kind}', '{syntax}', '{named}')" for n, (_, line, kind, syntax, named) in enumerate(_HARD))
_HARD_FILES = "SELECT 'f' || l_orderkey || '-' || l_linenumber || '.tsx' AS path, (l_partkey + l_linenumber) % 5 AS form, '@s' || (l_suppkey % 7) || '/p' || (l_partkey % 40) AS spec FROM lineitem"


@register(
    "S3_hard_syntax",
    f"""SELECT path, CAST(line AS BIGINT) AS line, spec AS specifier, import_kind, syntax, named
        FROM ({_HARD_FILES}) JOIN (VALUES {_HARD_ROWS}) v(form, line, import_kind, syntax, named) USING (form)""",
)
def s3_hard(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").selectExpr(
        "'f' || l_orderkey || '-' || l_linenumber || '.tsx' AS path", "(l_partkey + l_linenumber) % 5 AS form",
        "'@s' || (l_suppkey % 7) || '/p' || (l_partkey % 40) AS spec",
    )
    sources = lineitem.selectExpr("path", f"CASE form {_HARD_CASES} END AS content")
    sites = script.extract_imports(script.script_regions(sources))
    return sites.select("path", "line", "specifier", "import_kind", "syntax", F.array_join("named", ",").alias("named"))


_RULE_LINES = (
    "CASE o_orderkey % 7 WHEN 0 THEN '  package:moment' || o_custkey || ' ' WHEN 1 THEN '# comment' WHEN 2 THEN '' WHEN 3 THEN 'import:@x/*'"
    " WHEN 4 THEN 'path:src/g' || o_custkey || '/**' WHEN 5 THEN 'other:thing' || o_custkey ELSE 'plain' || o_custkey END"
)


@register(
    "S6_read_ignore_rules",
    f"""SELECT o_orderkey AS id, CASE WHEN k IN ('package', 'import', 'path') THEN k ELSE 'import' END AS kind,
        CASE WHEN k IN ('package', 'import', 'path') THEN substr(t, length(k) + 2) ELSE t END AS pattern
        FROM (SELECT *, split_part(t, ':', 1) AS k FROM (SELECT *, trim({_RULE_LINES}) AS t FROM orders)) WHERE t <> '' AND NOT starts_with(t, '#')""",
)
def s6(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_RULE_LINES} AS line")
    return text.read_ignore_rules(lines)


@register(
    "S7_parse_tool_logs",
    oracle(
        r"""SELECT event_id, '2024-01-01T00:00:00Z' AS logged_at, lower(regexp_extract(line, '\[(ERROR|info|Warn|debug)\]', 1)) AS level,
            CASE WHEN contains(line, ' [c') THEN regexp_extract(line, '\[(c[0-9])\]', 1) END AS component, 'event ' || event_id || ' done' AS message
            FROM logs WHERE NOT starts_with(line, 'free')""",
        "logs",
    ),
)
def s7(spark, sf_dir):
    return text.parse_tool_logs(view(spark, sf_dir, "logs").select("event_id", "line"), "sizer")


_CONFIG = (
    "CASE c_custkey % 6 WHEN 0 THEN '{\"budgets\":{\"perImportBrotliBytes\":' || c_custkey || '.7,\"perFileBrotliBytes\":\"90\"}}'"
    " WHEN 1 THEN '{\"tool\":{\"budgets\":{\"perFileBrotliBytes\":' || (c_custkey * 3) || '}}}' WHEN 2 THEN '{\"budgets\":{\"perImportBrotliBytes\":-5,\"perFileBrotliBytes\":0}}'"
    " WHEN 3 THEN '{}' WHEN 4 THEN '{\"budgets\":{\"perImportBrotliBytes\":0.5,\"perFileBrotliBytes\":true}}' ELSE '{\"budgets\":{\"perImportBrotliBytes\":1e3}}' END"
)


@register(
    "S8_read_budgets",
    """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN c_custkey WHEN 4 THEN 0 WHEN 5 THEN 1000 END AS per_import_brotli_bytes,
       CASE c_custkey % 6 WHEN 1 THEN c_custkey * 3 END AS per_file_brotli_bytes FROM customer""",
)
def s8(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_CONFIG} AS json")
    return text.budgets_from_json(documents, nested_under="tool")


_BREAK = r"replace(text, chr(13) || chr(10), chr(10))"


@register(
    "J18_changed_lines",
    f"""SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [p, n + 1] ELSE [p] END) AS line
        FROM (SELECT doc_id, n, doc_id % (n + 1) AS p FROM (SELECT doc_id, len(string_split({_BREAK}, chr(10))) AS n FROM documents WHERE doc_id % 5 <> 0)))""",
)
def j18(spark, sf_dir):
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    n = F.size("lines")
    p = (F.col("doc_id") % (n + 1)).cast("int")
    marker = F.array(F.concat(F.lit("@@ added "), F.col("doc_id").cast("string")))
    edited = F.concat(
        F.slice("lines", F.lit(1), p),
        marker,
        F.slice("lines", p + 1, n),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("@@ last "), F.col("doc_id").cast("string")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    pairs = (
        table(spark, sf_dir, "documents")
        .withColumn("lines", lines)
        .select(
            "doc_id",
            F.col("text").alias("base"),
            F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.array_join(edited, "\n")).alias("current"),
        )
    )
    return changes.changed_lines(pairs, ["doc_id"])


# ---- the whole report -------------------------------------------------------
_REPORT = """SELECT f.workspace, f.path AS source_file, f.line + 1 AS line, f.specifier,
    CASE WHEN c.package_name IS NOT NULL THEN m.brotli_bytes END AS brotli_bytes,
    CASE WHEN c.package_name IS NOT NULL AND m.brotli_bytes IS NOT NULL THEN 'high' ELSE 'unknown' END AS confidence
  FROM found f LEFT JOIN (SELECT DISTINCT 'w' || (l_orderkey % 20) AS workspace, '@s' || (l_suppkey % 7) || '/p' || (l_partkey % 40) AS package_name FROM lineitem WHERE l_partkey % 3 <> 0) c
    ON c.workspace = f.workspace AND c.package_name = f.specifier
  LEFT JOIN (SELECT specifier, import_kind, named, max((sk + 1) * 1000 + pk * 10) AS brotli_bytes FROM found WHERE pk <> 6 GROUP BY ALL) m
    ON m.specifier = f.specifier AND m.import_kind = f.import_kind AND m.named = f.named
  WHERE NOT (f.workspace IN (SELECT 'w' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0) AND starts_with(f.specifier, '@s3/p1'))"""


def _report(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    sources = _sources(spark, sf_dir)
    rules = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr(
        "'w' || n_nationkey AS workspace", "'src' AS dir", "'package' AS kind", "'@s3/p1*' AS pattern"
    )
    copies = lineitem.where("l_partkey % 3 <> 0").selectExpr(
        "'w' || (l_orderkey % 20) AS workspace", "'src' AS dir", "'@s' || (l_suppkey % 7) || '/p' || (l_partkey % 40) AS package_name", "'1.0' AS version"
    )
    per_form = [
        lineitem.where(f"l_suppkey % 10 <> 0 AND {key} % 40 <> 6").selectExpr(
            f"{_spec(key)} AS specifier",
            f"CASE {form} WHEN 0 THEN array('default') WHEN 1 THEN array('namespace') WHEN 2 THEN array('named') WHEN 4 THEN array('namespace')"
            " WHEN 5 THEN array('named') WHEN 6 THEN array('dynamic') WHEN 8 THEN array('default', 'named') WHEN 9 THEN array('namespace') ELSE array() END AS kinds",
            f"CASE WHEN {form} = 2 THEN array({_N1}, {_N2}) ELSE array({_N1}) END AS named",
            f"(l_suppkey % 7 + 1) * 1000 + {key} % 40 * 10 AS size",
        )
        for form, key in _FORMS
    ]
    kinds = per_form[0].unionByName(per_form[1])
    measurements = (
        kinds.select("specifier", F.explode("kinds").alias("import_kind"), F.array_sort(F.array_distinct("named")).alias("named"), "size")
        .groupBy("specifier", "import_kind", F.when(F.col("import_kind") == "named", F.col("named")).otherwise(F.array().cast("array<string>")).alias("named"))
        .agg(F.max("size").alias("brotli_bytes"))
        .selectExpr(
            "specifier", "import_kind", "named", "'component' AS runtime", "brotli_bytes * 4 AS raw_bytes", "brotli_bytes * 3 AS minified_bytes",
            "brotli_bytes AS gzip_bytes", "brotli_bytes", "brotli_bytes AS zstd_bytes", "false AS side_effects", "true AS truly_treeshakeable", "false AS is_cjs",
            "'high' AS confidence", "CAST(array() AS array<string>) AS confidence_reasons", "CAST(NULL AS string) AS error", "CAST(NULL AS string) AS unmeasured_stage",
            "CAST(array() AS array<struct<stage:string>>) AS diagnostics", "array(named_struct('path', '/node_modules/' || specifier || '/i.js', 'bytes', brotli_bytes)) AS module_breakdown",
            "CAST(0 AS BIGINT) AS shared_bytes",
        )
    )
    return jobs.workspace_report(sources, rules, copies, measurements, view(spark, sf_dir, "budgets"))


@register("Q1_workspace_report", oracle(_REPORT, statements=_STATEMENTS_SQL, found=_FOUND_SQL))
def q1(spark, sf_dir):
    return _report(spark, sf_dir).select(
        "workspace", "source_file", "line", "specifier", "brotli_bytes", "confidence"
    )


def _derived(spark, sf_dir, name):
    """A table of the report behind the job."""
    return sinks.report_tables(_report(spark, sf_dir))[name]


def _behind(sql: str) -> str:
    return oracle(sql, statements=_STATEMENTS_SQL, found=_FOUND_SQL, report=_REPORT)


@register(
    "Q1_report_rows_in_order",
    _behind(
        """SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY brotli_bytes DESC NULLS LAST, source_file || ':' || line || ':' || specifier) AS position, brotli_bytes
           FROM report"""
    ),
)
def q1_order(spark, sf_dir):
    order = [F.col("brotli_bytes").desc_nulls_last(), report.position_text()]
    numbered = ranges.row_numbers(_report(spark, sf_dir), ["workspace"], order, "position", ["workspace", "brotli_bytes"])
    return numbered.select("workspace", F.col("position").cast("long").alias("position"), "brotli_bytes")


@register(
    "Q1_report_summary",
    _behind(
        """SELECT workspace, count(*) AS import_count, CAST(coalesce(sum(brotli_bytes), 0) AS BIGINT) AS combined_brotli_bytes,
           count(*) FILTER (WHERE confidence = 'low') AS low_confidence_count, count(*) FILTER (WHERE confidence = 'medium') AS medium_confidence_count,
           CAST(0 AS BIGINT) AS conservative_count, count(*) FILTER (WHERE brotli_bytes > per_import) AS budget_violation_count
           FROM report LEFT JOIN (SELECT 'w' || n_nationkey AS w, CASE WHEN n_nationkey <> 0 THEN 80000 - n_nationkey * 1000 END AS per_import FROM nation) b ON b.w = workspace
           GROUP BY workspace"""
    ),
)
def q1_summary(spark, sf_dir):
    return _derived(spark, sf_dir, "summary")


@register(
    "Q1_report_duplicates",
    _behind(
        """SELECT workspace, specifier, count(*) AS import_count, CAST(coalesce(sum(brotli_bytes), 0) AS BIGINT) AS combined_brotli_bytes, count(DISTINCT source_file) AS file_count
           FROM report GROUP BY workspace, specifier HAVING count(*) > 1"""
    ),
)
def q1_duplicates(spark, sf_dir):
    return _derived(spark, sf_dir, "duplicates")


@register(
    "Q1_report_duplicate_files",
    _behind(
        """SELECT workspace, specifier, source_file, count(*) AS imports_in_file FROM report
           WHERE (workspace, specifier) IN (SELECT (workspace, specifier) FROM report GROUP BY workspace, specifier HAVING count(*) > 1)
           GROUP BY workspace, specifier, source_file"""
    ),
)
def q1_duplicate_files(spark, sf_dir):
    return _derived(spark, sf_dir, "duplicate_files")


_REPORT_PARTS = "(SELECT *, '/node_modules/' || specifier || '/i.js' AS module_path FROM report WHERE brotli_bytes IS NOT NULL)"


@register(
    "Q1_report_shared_modules",
    _behind(
        f"""SELECT workspace, module_path, count(*) AS import_count, max(brotli_bytes) AS module_bytes, CAST(sum(brotli_bytes) AS BIGINT) AS combined_bytes,
            count(DISTINCT specifier) AS specifier_count, 'i.js' AS basename FROM {_REPORT_PARTS} GROUP BY workspace, module_path HAVING count(*) > 1"""
    ),
)
def q1_shared_modules(spark, sf_dir):
    return _derived(spark, sf_dir, "shared_modules").drop("vendored")


@register(
    "Q1_report_shared_module_specifiers",
    _behind(f"SELECT workspace, module_path, specifier FROM {_REPORT_PARTS} GROUP BY workspace, module_path, specifier HAVING count(*) > 1"),
)
def q1_shared_module_specifiers(spark, sf_dir):
    return _derived(spark, sf_dir, "shared_module_specifiers")


@register(
    "Q1_report_treemap",
    _behind(
        """SELECT workspace, position, specifier, source_file, brotli_bytes, (brotli_bytes * 100 + total // 2) // total AS percentage FROM
           (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY brotli_bytes DESC NULLS LAST, source_file || ':' || line || ':' || specifier) AS position,
              CAST(sum(brotli_bytes) OVER (PARTITION BY workspace) AS BIGINT) AS total FROM report) WHERE position <= 10 AND brotli_bytes > 0"""
    ),
)
def q1_treemap(spark, sf_dir):
    return _derived(spark, sf_dir, "treemap").select(
        "workspace", F.col("position").cast("long").alias("position"), "specifier", "source_file", "brotli_bytes", "percentage"
    )
