"""Scalar rules P1–P42 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.adapters import NOW_MS, table, view
from ballast.catalog import register
from ballast.catalog.sql import kilo_text, listed, oracle
from ballast.functions import identity as I
from ballast.functions import labels as L
from ballast.functions import manifests as M
from ballast.functions import quality as Q
from ballast.functions import registry as G
from ballast.functions import specifiers as S
from ballast.operators import freshness, resolve
from ballast.sources import files, text


def _map(key, source, build, sql, *views, keep=("id",)):
    """A projection of one view: key columns and one or more results."""

    @register(key, oracle(sql, *(views or (source,))))
    def query(spark, sf_dir):
        return view(spark, sf_dir, source).select(*keep, *build())

    return query


_map(
    "P1_package_name", "specs", lambda: [S.package_name(F.col("specifier")).alias("package_name")],
    """SELECT id, CASE WHEN starts_with(specifier, '@') AND contains(specifier, '/')
       THEN split_part(specifier, '/', 1) || '/' || split_part(specifier, '/', 2)
       ELSE split_part(specifier, '/', 1) END AS package_name FROM specs""",
)
_map(
    "P2_is_runtime_package", "specs",
    lambda: [S.is_runtime_package(F.col("specifier")).alias("is_runtime_package")],
    f"""SELECT id, NOT (starts_with(specifier, './') OR starts_with(specifier, '../') OR starts_with(specifier, '/')
       OR regexp_matches(specifier, '^[A-Za-z]:[/\\\\]')
       OR replace(specifier, 'node:', '') IN ({listed(V.NODE_MODULES)}) OR specifier IN ({listed(V.NODE_PREFIXED_ONLY)})
       OR regexp_matches(specifier, '^[A-Za-z][A-Za-z0-9+.-]*:')
       OR substr(specifier, 1, 1) IN ('$', '#') OR starts_with(specifier, '@/') OR starts_with(specifier, '~/')
       OR specifier IN ('vscode', 'electron')) AS is_runtime_package FROM specs""",
)
_map(
    "P3_is_safe_package_name", "specs",
    lambda: [S.is_safe_package_name(F.col("specifier")).alias("is_safe")],
    """SELECT id, CASE WHEN starts_with(specifier, '@') THEN
         len(string_split(specifier, '/')) = 2 AND length(split_part(specifier, '/', 1)) > 1
         AND split_part(specifier, '/', 2) NOT IN ('', '.', '..') ELSE
         NOT contains(specifier, '/') AND specifier NOT IN ('', '.', '..') END
       AND NOT contains(specifier, ':') AND NOT contains(specifier, '\\') AS is_safe FROM specs""",
)
_map(
    "P5_classify_asset", "paths", lambda: [S.classify_asset(F.col("path")).alias("asset_class")],
    f"""SELECT id, CASE WHEN e IN ({listed(V.CSS_EXTENSIONS)}) THEN 'css' WHEN e = 'wasm' THEN 'wasm'
       WHEN e IN ({listed(V.FONT_EXTENSIONS)}) THEN 'font' WHEN e IN ({listed(V.UNMEASURED_EXTENSIONS)}) THEN 'unmeasured' END
       AS asset_class FROM (SELECT id, CASE WHEN starts_with(split_part(path, '/', -1), '.') THEN ''
       ELSE lower(split_part(split_part(path, '/', -1), '.', -1)) END AS e FROM paths)""",
)

SITE = ("site",)


def _quality(key, build, sql_columns):
    _map(key, "sites", build, f"SELECT site, {sql_columns} FROM graded", "graded", keep=SITE)


_quality("P11_is_measured", lambda: [Q.is_measured().alias("is_measured")], "measured AS is_measured")
_quality("P12_is_transient", lambda: [Q.is_transient(F.col("diagnostics"), F.col("unmeasured_stage")).alias("is_transient")], "transient_ AS is_transient")
_quality("P13_is_durable", lambda: [Q.is_durable(F.col("diagnostics"), F.col("unmeasured_stage")).alias("is_durable")], "durable AS is_durable")
_quality("P14_is_budgetable", lambda: [Q.is_budgetable(F.col("diagnostics"), F.col("unmeasured_stage")).alias("is_budgetable")], "budgetable AS is_budgetable")
_quality(
    "P15_result_flags",
    lambda: [
        Q.has_uncounted(F.col("diagnostics")).alias("has_uncounted"),
        Q.is_types_only(F.col("diagnostics")).alias("is_types_only"),
        Q.is_native_binary_only(F.col("diagnostics")).alias("is_native_binary_only"),
        Q.is_native_binary(F.col("diagnostics")).alias("is_native_binary"),
    ],
    """coalesce(diag1 = 'uncounted_assets', false) AS has_uncounted,
       measured AND coalesce(diag1 = 'types_only', false) AS is_types_only,
       measured AND coalesce(diag1 = 'native_binary_only', false) AS is_native_binary_only,
       measured AND coalesce(diag1 = 'native_binary', false) AS is_native_binary""",
)
_quality(
    "P16_is_conservative",
    lambda: [Q.is_conservative(F.col("has_result"), F.col("is_cjs"), F.col("side_effects"), F.col("truly_treeshakeable")).alias("is_conservative")],
    "(has_result AND (is_cjs OR side_effects OR NOT truly_treeshakeable)) AS is_conservative",
)
_quality(
    "P18_confidence",
    lambda: [
        F.col("confidence"),
        F.array_join("confidence_reasons", " · ").alias("reasons"),
    ],
    "confidence, reasons",
)
_quality("P19_confidence_label", lambda: [Q.confidence_label(F.col("has_result"), F.col("confidence")).alias("label")], "CASE WHEN has_result THEN confidence ELSE 'unknown' END AS label")
_quality("P22_import_identity", lambda: [
    F.replace(I.import_identity(F.col("specifier"), F.col("import_kind"), F.col("runtime"), F.col("named")), F.lit("\u0000"), F.lit("|")).alias("identity_text"),
    I.import_label(F.col("specifier"), F.col("import_kind"), F.col("named")).alias("label"),
], """specifier || '|' || import_kind || '|' || runtime || '|' || replace(names, ',', chr(1)) AS identity_text,
      CASE WHEN import_kind = 'named' THEN specifier || ' { ' || replace(names, ',', ', ') || ' }'
      ELSE specifier || ' (' || import_kind || ')' END AS label""")
_quality("P31_tree_shake_reason", lambda: [Q.tree_shake_reason().alias("reason")],
    """CASE WHEN NOT measured THEN NULL WHEN is_cjs THEN 'CommonJS import may block precise tree-shaking.'
       WHEN side_effects THEN 'Package side effects require conservative sizing.'
       WHEN NOT truly_treeshakeable THEN 'Import is not tree-shakeable by the current analysis.' END AS reason""")
_quality("P32_narrowing_candidate", lambda: [Q.narrowing_candidate(F.col("status"), F.col("import_kind"), F.col("truly_treeshakeable")).alias("candidate")],
    "(status = 'ready' AND measured AND import_kind = 'namespace' AND NOT truly_treeshakeable) AS candidate")
_quality("P33_result_tags", lambda: [F.array_join(Q.result_tags(F.col("diagnostics"), F.col("runtime"), F.col("is_cjs")), ",").alias("tags")],
    """concat_ws(',', CASE WHEN runtime = 'server' THEN 'server' END, CASE WHEN measured AND diag1 = 'types_only' THEN 'types only' END,
       CASE WHEN measured AND diag1 = 'native_binary_only' THEN 'native binary only' WHEN measured AND diag1 = 'native_binary' THEN 'native binary' END,
       CASE WHEN is_cjs THEN 'CJS' END) AS tags""")
_quality("P41_selection", lambda: [Q.selection(F.col("import_kind"), F.filter(F.col("named"), lambda n: n != "n0")).alias("selection")],
    """CASE WHEN import_kind <> 'named' THEN import_kind WHEN n1 = 'n0' AND n2 = 'n0' THEN 'full' ELSE 'named' END AS selection""")
_quality("P26_bytes_for_compression", lambda: [L.bytes_for_compression(m).alias(f"{m}_size") for m in ("gzip", "zstd", "brotli", "all")],
    "gzip_bytes AS gzip_size, zstd_bytes AS zstd_size, brotli_bytes AS brotli_size, brotli_bytes AS all_size")


@register(
    "P25_format_bytes",
    oracle(
    f"""SELECT site, CASE WHEN brotli_bytes IS NOT NULL THEN {kilo_text('(brotli_bytes // 25)')} END AS text,
    CASE WHEN c < 1024 THEN c || ' B' WHEN c / 1024.0::DOUBLE < 1024 THEN CAST(floor(c / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' kB'
      WHEN c / 1048576.0::DOUBLE < 1024 THEN CAST(floor(c / 1048576.0::DOUBLE + 0.5) AS BIGINT) || ' MB'
      WHEN c IS NOT NULL THEN (t // 10) || '.' || (t % 10) || ' GB' END AS cache_text
    FROM sized""",
    "graded",
    sized="""SELECT *, CAST(floor(c / 1073741824.0::DOUBLE * 10 + 0.5) AS BIGINT) AS t FROM
      (SELECT *, brotli_bytes * brotli_bytes // 700 AS c FROM graded)""",
    ),
)
def p25(spark, sf_dir):
    return view(spark, sf_dir, "sites").select(
        "site",
        L.format_bytes(F.expr("brotli_bytes div 25")).alias("text"),
        L.format_cache_bytes(F.expr("brotli_bytes * brotli_bytes div 700")).alias("cache_text"),
    )


@register(
    "P17_truly_treeshakeable",
    oracle(
        """SELECT site, coalesce(import_kind = 'named' AND NOT side_effects AND full_minified > 0
           AND minified_bytes / full_minified::DOUBLE <= 0.95, false) AS shakeable
           FROM graded LEFT JOIN whole ON graded.package_name = whole.package_name AND graded.runtime = whole.runtime""",
        "graded",
        whole="""SELECT package_name, runtime, max(minified_bytes) AS full_minified FROM graded
           WHERE import_kind = 'namespace' GROUP BY package_name, runtime""",
    ),
)
def p17(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    whole = (
        sites.where(F.col("import_kind") == "namespace")
        .groupBy("package_name", "runtime")
        .agg(F.max("minified_bytes").alias("full_minified"))
    )
    verdict = Q.truly_treeshakeable(
        F.col("import_kind"), F.col("named"), F.col("side_effects"), F.col("minified_bytes"), F.col("full_minified")
    )
    return sites.join(whole, ["package_name", "runtime"], "left").select("site", verdict.alias("shakeable"))


@register("P20_row_warning", oracle("SELECT workspace, source_file, line, specifier, warning FROM rows_", "rows_"))
def p20(spark, sf_dir):
    limits = view(spark, sf_dir, "budgets")
    rows = view(spark, sf_dir, "sites").join(limits, "workspace", "left")
    return rows.select(
        "workspace",
        S.relative_source_file(F.col("workspace_root"), F.col("source_file")).alias("source_file"),
        (F.col("line") + 1).alias("line"),
        "specifier",
        Q.row_warning(F.col("per_import_brotli_bytes"), F.col("has_result")).alias("warning"),
    )


_map(
    "P21_paths", "sites",
    lambda: [
        S.relative_source_file(F.col("workspace_root"), F.col("source_file")).alias("relative"),
        S.basename(F.col("m2")).alias("basename"),
        S.is_vendored(F.col("m2")).alias("vendored"),
    ],
    """SELECT site, substr(source_file, length(workspace_root) + 2) AS relative, split_part(m2, '/', -1) AS basename,
       (len(string_split(m2, '/node_modules/')) > 2) AS vendored FROM sites""",
    keep=SITE,
)


@register(
    "P23_measurement_key",
    oracle(
        """SELECT count(*) AS sites, count(DISTINCT (specifier, import_kind, runtime, names)) AS keys FROM graded""",
        "graded",
    ),
)
def p23(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    key = I.measurement_key(
        F.lit("v8"), F.col("specifier"), F.col("import_kind"), F.col("runtime"), F.col("named")
    )
    per_key = sites.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("sites"), F.count(F.lit(1)).alias("keys"))


_map(
    "P24_is_first_party", "paths", lambda: [S.is_first_party(F.col("path")).alias("first_party")],
    "SELECT id, NOT list_contains(string_split(path, '/'), 'node_modules') AS first_party FROM paths",
)


@register(
    "P37_shard_id",
    oracle(
        """SELECT root, count(*) AS files FROM (SELECT CASE WHEN regexp_matches(path, '^.:') THEN lower(rtrim(path, '/'))
           ELSE rtrim(path, '/') END AS root FROM paths) GROUP BY root""",
        "paths",
    ),
)
def p37(spark, sf_dir):
    paths = view(spark, sf_dir, "paths")
    root = S.normal_root(F.col("path"))
    return (
        paths.groupBy(S.shard_id(F.col("path")).alias("shard"))
        .agg(F.max(root).alias("root"), F.count(F.lit(1)).alias("files"))
        .select("root", "files")
    )


_map(
    "P39_package_of_manifest_path", "paths",
    lambda: [S.package_of_manifest_path(F.col("path")).alias("package_name")],
    """SELECT id, CASE WHEN contains(path, '/node_modules/') THEN CASE WHEN starts_with(t, '@')
       THEN split_part(t, '/', 1) || '/' || split_part(t, '/', 2) ELSE split_part(t, '/', 1) END END AS package_name
       FROM (SELECT *, split_part(path, '/node_modules/', -1) AS t FROM paths)""",
)
_map(
    "P40_is_workspace_config", "paths",
    lambda: [S.is_workspace_config(F.col("path")).alias("is_config")],
    r"""SELECT id, regexp_matches(split_part(path, '/', -1), '^(ts|js)config(\.[^./]+)?\.json$')
       AND NOT contains(path, '/node_modules/') AS is_config FROM paths""",
)


@register(
    "P4_apply_ignore_rules",
    oracle(
        """SELECT site FROM sites s WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.workspace = s.workspace AND
           CASE r.kind WHEN 'package' THEN regexp_full_match(s.package_name, r.regex)
             WHEN 'import' THEN regexp_full_match(s.specifier, r.regex)
             ELSE regexp_matches(s.source_file, '(^|/)' || r.regex || '$') END)""",
        "sites",
        rules="""SELECT 'w' || n_nationkey AS workspace, CASE n_nationkey % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'import' ELSE 'path' END AS kind,
          CASE n_nationkey % 4 WHEN 0 THEN '@s' || (n_nationkey % 7) || '/p1[^/]*' WHEN 1 THEN '@s1/.*'
            WHEN 2 THEN 'src/d' || (n_nationkey % 9) || '/.*' ELSE 'f[^/]*7\\.ts' END AS regex FROM nation
          UNION ALL SELECT 'w' || n_nationkey, 'package', '@s2/p' || n_nationkey FROM nation""",
    ),
)
def p4(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rules = nation.selectExpr(
        "'w' || n_nationkey AS workspace",
        "'/repo/w' || n_nationkey AS dir",
        "CASE n_nationkey % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'import' ELSE 'path' END AS kind",
        "CASE n_nationkey % 4 WHEN 0 THEN '@s' || (n_nationkey % 7) || '/p1*' WHEN 1 THEN '@s1/**'"
        " WHEN 2 THEN 'src/d' || (n_nationkey % 9) || '/**' ELSE 'f*7.ts' END AS pattern",
    ).unionByName(
        nation.selectExpr(
            "'w' || n_nationkey AS workspace",
            "'/repo/w' || n_nationkey AS dir",
            "'package' AS kind",
            "'@s2/p' || n_nationkey AS pattern",
        )
    )
    sites = view(spark, sf_dir, "sites").withColumn("path", F.col("source_file"))
    return resolve.apply_ignore_rules(sites, rules).select("site")


_CSS = (
    "CASE p_partkey % 12 WHEN 0 THEN 'fonts/f' || (p_partkey % 40) || '.woff2?v=1#x' WHEN 1 THEN '../img/i' || (p_partkey % 40) || '.png'"
    " WHEN 2 THEN 'https:' || '/' || '/cdn/a.css' WHEN 3 THEN '/' || '/cdn/x.woff' WHEN 4 THEN '#frag' WHEN 5 THEN 'data:image/png;base64,AA'"
    " WHEN 6 THEN '/rooted/x.woff' WHEN 7 THEN 'bad%ff.woff' WHEN 8 THEN 'fonts/a%20b' || (p_partkey % 40) || '.ttf'"
    " WHEN 9 THEN './mod' || (p_partkey % 40) || '.wasm' WHEN 10 THEN 'a+b%zz.eot' ELSE 'missing/m' || p_partkey || '.otf' END"
)
_ASSET = (
    "CASE p_partkey % 6 WHEN 0 THEN '/w/css/fonts/f' || (p_partkey % 40) || '.woff2' WHEN 1 THEN '/w/img/i' || (p_partkey % 40) || '.png'"
    " WHEN 2 THEN '/w/css/fonts/a b' || (p_partkey % 40) || '.ttf' WHEN 3 THEN '/w/css/mod' || (p_partkey % 40) || '.wasm'"
    " WHEN 4 THEN '/w/css/a+b%zz.eot' ELSE '/w/css/other' || (p_partkey % 40) || '.bin' END"
)


@register(
    "P6_classify_css_reference",
    f"""WITH refs AS (SELECT 'w' || (p_partkey % 5) AS workspace, '/w/css/s' || (p_partkey % 300) || '.css' AS source_file,
          {_CSS} AS url, p_partkey % 12 AS k, p_partkey AS id FROM part),
        resolved AS (SELECT *, CASE k WHEN 0 THEN '/w/css/fonts/f' || (id % 40) || '.woff2' WHEN 1 THEN '/w/img/i' || (id % 40) || '.png'
          WHEN 8 THEN '/w/css/fonts/a b' || (id % 40) || '.ttf' WHEN 9 THEN '/w/css/mod' || (id % 40) || '.wasm'
          WHEN 10 THEN '/w/css/a+b%zz.eot' WHEN 11 THEN '/w/css/' || url END AS path FROM refs),
        assets AS (SELECT 'w' || (p_partkey % 5) AS workspace, {_ASSET} AS path, CAST(max(p_size) AS BIGINT) AS len FROM part GROUP BY 1, 2)
        SELECT DISTINCT r.workspace, source_file, CASE WHEN k IN (2, 3) THEN 'external' WHEN k IN (6, 7) THEN 'omitted'
          WHEN a.path IS NULL THEN 'unreadable' WHEN k = 1 THEN 'uncounted' ELSE 'counted' END AS reference,
          coalesce(r.path, url) AS target, a.len AS asset_bytes
        FROM resolved r LEFT JOIN assets a ON a.workspace = r.workspace AND a.path = r.path WHERE k NOT IN (4, 5)""",
)
def p6(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sheets = part.selectExpr(
        "'w' || (p_partkey % 5) AS workspace",
        "'/w/css/s' || (p_partkey % 300) || '.css' AS source_file",
        f"'/* url(no.woff) */ .a {{ background: url(\"' || {_CSS} || '\") }}' AS content",
    )
    assets = (
        part.selectExpr("'w' || (p_partkey % 5) AS workspace", f"{_ASSET} AS path", "CAST(p_size AS BIGINT) AS len")
        .groupBy("workspace", "path")
        .agg(F.max("len").alias("len"))
    )
    return text.classify_css_references(text.css_references(sheets), assets)


_MANIFEST = (
    "'{\"name\":\"p' || p_partkey || '\",\"version\":' || CASE WHEN p_partkey % 10 = 9 THEN '3' ELSE '\"1.' || p_size || '.0\"' END"
    " || CASE p_partkey % 7 WHEN 0 THEN ',\"sideEffects\":false' WHEN 1 THEN ',\"sideEffects\":true'"
    " WHEN 2 THEN ',\"sideEffects\":[\"*.css\",\"./lib/index.js\",4]' WHEN 3 THEN ',\"sideEffects\":\"lib/*.js\"'"
    " WHEN 4 THEN ',\"sideEffects\":[]' WHEN 5 THEN ',\"sideEffects\":7' ELSE '' END"
    " || CASE p_size % 6 WHEN 0 THEN ',\"type\":\"module\"' WHEN 1 THEN ',\"type\":\"commonjs\"' WHEN 2 THEN ',\"module\":\"./lib/index.js\"'"
    " WHEN 3 THEN ',\"exports\":{\".\":{\"import\":\"./lib/index.js\",\"require\":\"./lib/index.cjs\"}}'"
    " WHEN 4 THEN ',\"exports\":{\".\":[{\"require\":\"./lib/index.js\"}]}' ELSE ',\"exports\":{\".\":{\"require\":[\"./x.js\",\"./lib/index.js\"]}}' END"
    " || CASE p_partkey % 5 WHEN 0 THEN ',\"optionalDependencies\":{\"@b/cli-linux-x64-musl\":\"1\"}'"
    " WHEN 1 THEN ',\"optionalDependencies\":{\"x64-arm-tool\":\"1\"}' WHEN 2 THEN ',\"optionalDependencies\":{\"q-darwin-arm64\":\"1\"}' ELSE '' END || '}'"
)
_ENTRY = "CASE p_partkey % 8 WHEN 0 THEN 'lib/index.cjs' WHEN 1 THEN 'lib/index.mjs' WHEN 2 THEN 'lib/index.ts' WHEN 3 THEN 'style/a.css' ELSE 'lib/index.js' END"


def _manifests(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.selectExpr("p_partkey AS id", f"{_ENTRY} AS entry", f"{_MANIFEST} AS manifest").withColumn(
        "manifest", M.parsed(F.col("manifest"))
    )


@register(
    "P7_side_effects_mode",
    f"""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 5 THEN 'unknown' WHEN 6 THEN 'missing' ELSE 'array' END AS mode,
        CASE p_partkey % 7 WHEN 0 THEN false WHEN 2 THEN e IN ('style/a.css', 'lib/index.js') WHEN 3 THEN e = 'lib/index.js'
          WHEN 4 THEN false ELSE true END AS has_side_effects FROM (SELECT *, {_ENTRY} AS e FROM part)""",
)
def p7(spark, sf_dir):
    return _manifests(spark, sf_dir).select(
        "id",
        M.side_effects_mode(F.col("manifest")).alias("mode"),
        M.has_side_effects(F.col("manifest"), F.col("entry")).alias("has_side_effects"),
    )


@register(
    "P8_is_commonjs",
    f"""SELECT p_partkey AS id, CASE WHEN e = 'lib/index.cjs' THEN true WHEN e IN ('lib/index.mjs', 'lib/index.ts') THEN false
          WHEN p_size % 6 = 0 THEN false WHEN p_size % 6 = 1 THEN true
          WHEN e <> 'lib/index.js' THEN false
          WHEN p_size % 6 IN (2, 3) THEN false ELSE true END AS is_commonjs FROM (SELECT *, {_ENTRY} AS e FROM part)""",
)
def p8(spark, sf_dir):
    return _manifests(spark, sf_dir).select(
        "id", M.is_commonjs(F.col("manifest"), F.col("entry")).alias("is_commonjs")
    )


@register(
    "P9_native_binary_flags",
    """SELECT p_partkey AS id, (p_partkey % 5 IN (0, 2)) AS native_backed,
       (p_partkey % 5 IN (0, 2) AND p_size % 6 IN (0, 1)) AS native_only FROM part""",
)
def p9(spark, sf_dir):
    return _manifests(spark, sf_dir).select(
        "id",
        M.is_native_backed(F.col("manifest")).alias("native_backed"),
        M.is_native_only(F.col("manifest")).alias("native_only"),
    )


_PACKAGE_FILE = (
    "CASE l_linenumber % 4 WHEN 0 THEN 'types/i' || l_linenumber || '.d.ts' WHEN 1 THEN 'node_modules/x/i.js'"
    " WHEN 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'lib/index.D.MTS' ELSE 'readme.md' END"
    " ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'lib/a.js' ELSE 'x.json' END END"
)


@register(
    "P10_declaration_only",
    f"""SELECT package_root, has_declaration, has_runtime, files, has_declaration AND NOT has_runtime AS declaration_only
        FROM (SELECT 'r' || l_orderkey AS package_root,
          bool_or(path LIKE 'types/%' OR path = 'lib/index.D.MTS') AS has_declaration, bool_or(path = 'lib/a.js') AS has_runtime,
          count(*) AS files FROM (SELECT *, {_PACKAGE_FILE} AS path FROM lineitem) WHERE path NOT LIKE 'node_modules/%' GROUP BY 1)""",
)
def p10(spark, sf_dir):
    listed_files = table(spark, sf_dir, "lineitem").selectExpr(
        "'r' || l_orderkey AS package_root", f"{_PACKAGE_FILE} AS path"
    )
    return files.declaration_only(listed_files, ["package_root"])


@register(
    "P27_version_status",
    oracle(
        f"""SELECT position, CASE WHEN suffix IS NOT NULL AND status <> 'missing' AND latest_version IS NOT NULL
             AND {NOW_MS} - published_ms BETWEEN 0 AND 86399999 THEN '✦ ' || suffix ELSE suffix END AS version_status
           FROM (SELECT *, CASE WHEN latest_version IS NULL THEN CASE WHEN stale THEN 'registry stale' END
             WHEN stale THEN coalesce('stale · ' || base, 'registry stale') ELSE base END AS suffix
           FROM (SELECT d.*, r.latest_version, r.published_ms, coalesce(refresh = 'stale', false) AS stale,
             CASE WHEN status = 'missing' THEN 'install ' || latest_version WHEN installed_version = latest_version THEN 'latest'
                  WHEN installed_version <> latest_version THEN 'update ' || latest_version END AS base
             FROM dependencies d LEFT JOIN registry r ON d.name = r.name))""",
        "dependencies", "registry",
    ),
)
def p27(spark, sf_dir):
    known = view(spark, sf_dir, "registry").select("name", "latest_version", "published_ms")
    joined = view(spark, sf_dir, "dependencies").join(known, "name", "left")
    return joined.select(
        "position",
        L.version_status(
            F.col("status"),
            F.col("latest_version"),
            F.col("installed_version") == F.col("latest_version"),
            F.col("refresh"),
            F.col("published_ms"),
            F.lit(NOW_MS),
        ).alias("version_status"),
    )


_map(
    "P28_dependency_state", "dependencies",
    lambda: [L.dependency_state(F.col("status"), F.col("diagnostics")).alias("state")],
    """SELECT position, CASE WHEN status = 'loading' THEN 'checking' WHEN status = 'missing' THEN 'not_installed'
       WHEN status = 'unavailable' OR brotli_bytes IS NULL THEN 'unavailable' WHEN diag1 = 'types_only' THEN 'types_only'
       WHEN diag1 = 'native_binary_only' THEN 'native_binary_only' ELSE 'measured' END AS state FROM dependencies""",
    keep=("position",),
)


@register(
    "P29_file_cost_quality",
    oracle(
        """SELECT site, quantity, short, imprecise, CASE WHEN quantity <> 'file-cost' THEN 'Combined Import Cost'
             WHEN short AND imprecise THEN 'File Cost, bound in neither direction' WHEN short THEN 'File Cost floor'
             WHEN imprecise THEN 'File Cost upper bound' ELSE 'File Cost' END AS name,
             (quantity = 'file-cost' AND NOT short AND NOT imprecise) AS is_file_cost
           FROM (SELECT site, CASE WHEN is_cjs THEN 'combined-import-cost' ELSE 'file-cost' END AS quantity, imprecise,
             side_effects OR (NOT is_cjs AND (coalesce(diag1 = 'asset_io', false) OR coalesce(diag2 = 'timeout', false))) AS short FROM graded)""",
        "graded",
    ),
)
def p29(spark, sf_dir):
    # here `side_effects` stands for an incomplete total and `is_cjs` for a degraded one
    rows = view(spark, sf_dir, "sites")
    judged = Q.file_cost_quality(F.col("diagnostics"), F.col("side_effects"), F.col("is_cjs"))
    return rows.select("site", judged.alias("q")).select("site", "q.*")


_RESPONSE = {
    "status": "CASE user_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 400 ELSE 200 END",
    "too_large": "(event_id % 50 = 0)",
    "header": "CASE WHEN event_id % 3 = 0 THEN CAST(1500 AS BIGINT) END",
    "attempt": "CAST(event_id % 3 + 1 AS BIGINT)",
    "cached_version": "CASE WHEN event_id % 4 <> 0 THEN '1.' || (event_id % 7) END",
    "cached_at": "CASE WHEN event_id % 4 <> 0 THEN event_id * 10 END",
    "fetched_version": "'2.' || (event_id % 5)",
}
_RESPONSE_SQL = "SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in _RESPONSE.items()) + " FROM events"


@register(
    "P34_registry_next_state",
    f"""SELECT event_id, CASE WHEN too_large THEN 'oversize' WHEN status = 200 THEN 'fresh' WHEN status = 404 THEN 'not_found'
          WHEN status = 429 THEN 'rate_limited' ELSE 'failed' END AS outcome,
        CASE WHEN NOT too_large AND status = 200 THEN fetched_version WHEN NOT too_large AND status = 404 THEN NULL ELSE cached_version END AS latest_version,
        CASE WHEN NOT too_large AND status IN (200, 404) THEN {NOW_MS} ELSE coalesce(cached_at, 0) END AS updated_at,
        CASE WHEN too_large THEN {NOW_MS} + 21600000 WHEN status IN (200, 404) THEN NULL WHEN status = 429 THEN {NOW_MS} + coalesce(header, attempt * 100)
          ELSE {NOW_MS} + 300000 END AS retry_after,
        (NOT too_large AND status = 404) AS not_found FROM ({_RESPONSE_SQL})""",
)
def p34(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", *[f"{e} AS {c}" for c, e in _RESPONSE.items()]
    )
    state = G.next_state(
        F.col("status"),
        F.col("too_large"),
        F.col("header"),
        F.col("attempt"),
        F.lit(NOW_MS),
        F.struct(F.col("fetched_version").alias("latest_version")),
        F.struct(F.col("cached_version").alias("latest_version"), F.col("cached_at").alias("updated_at")),
    )
    return rows.select("event_id", state.alias("s")).select("event_id", "s.*")


@register(
    "P35_registry_needs_refresh",
    oracle(
        f"""SELECT d.position, m.mode, CASE WHEN m.mode IN ('off', 'cached') THEN false WHEN r.name IS NULL THEN true
             WHEN m.mode = 'refresh_stale' THEN NOT (CASE WHEN r.latest_version IS NOT NULL THEN {NOW_MS} - updated_at <= 21600000
               ELSE not_found AND {NOW_MS} - updated_at <= 21600000 END OR coalesce(retry_after > {NOW_MS}, false))
             ELSE d.position % 6 <> 0 END AS needs_refresh
           FROM dependencies d JOIN (SELECT unnest(['off', 'cached', 'refresh_stale', 'force']) AS mode) m ON true
           LEFT JOIN registry r ON d.name = r.name""",
        "dependencies", "registry",
    ),
)
def p35(spark, sf_dir):
    known = view(spark, sf_dir, "registry").withColumn("has_entry", F.lit(True))
    modes = F.array(*[F.lit(m) for m in ("off", "cached", "refresh_stale", "force")])
    asked = (
        view(spark, sf_dir, "dependencies")
        .select("position", "name")
        .join(known, "name", "left")
        .withColumn("mode", F.explode(modes))
    )
    return asked.select(
        "position",
        "mode",
        G.needs_refresh(
            F.col("mode"),
            F.coalesce("has_entry", F.lit(False)),
            F.col("latest_version").isNotNull(),
            F.col("not_found"),
            F.col("updated_at"),
            F.col("retry_after"),
            F.col("position") % 6 == 0,
            F.lit(NOW_MS),
        ).alias("needs_refresh"),
    )


@register(
    "P36_is_orphan_entry",
    oracle(
        """SELECT shard_id, key FROM store WHERE analyzer_version <> 'v8'
           OR (entry_path IS NOT NULL AND entry_path NOT IN (SELECT path FROM live_paths))
           OR (package_root IS NOT NULL AND package_root NOT IN (SELECT path FROM live_paths))""",
        "store", "live_paths",
    ),
)
def p36(spark, sf_dir):
    orphans = freshness.orphan_entries(view(spark, sf_dir, "store"), view(spark, sf_dir, "live_paths"), "v8")
    return orphans.select("shard_id", "key")


@register(
    "P42_uncounted_assets_message",
    """SELECT id, 'package ships ' || (CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END) || ' non-JavaScript asset(s) ' ||
         CASE WHEN id % 3 = 0 THEN CASE WHEN b1 > 0 THEN 'totalling ' || b1 || ' bytes' ELSE 'of unknown size' END
              WHEN b1 > 0 AND b2 > 0 THEN 'totalling ' || (b1 + b2) || ' bytes'
              WHEN b1 + b2 > 0 THEN 'totalling at least ' || (b1 + b2) || ' bytes' ELSE 'of unknown size' END ||
         ' that this size does NOT include: a' || id || '.png' || CASE WHEN id % 3 = 0 THEN '' ELSE ', b.mp4' END AS message
       FROM (SELECT p_partkey AS id, CAST(p_size % 4 AS BIGINT) AS b1, CAST(p_partkey % 5 AS BIGINT) AS b2 FROM part)""",
)
def p42(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CAST(p_size % 4 AS BIGINT) AS b1", "CAST(p_partkey % 5 AS BIGINT) AS b2"
    )
    first = F.struct(F.concat(F.lit("/i/a"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.col("b1").alias("bytes"))
    second = F.struct(F.lit("/i/b.mp4").alias("path"), F.col("b2").alias("bytes"))
    assets = F.when(F.col("id") % 3 == 0, F.array(first)).otherwise(F.array(first, second))
    return rows.select("id", Q.uncounted_assets_message(assets).alias("message"))
