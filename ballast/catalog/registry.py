"""Registry, manifests, freshness, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.adapters import NOW_MS, table, view
from ballast.catalog import register
from ballast.catalog.sql import kilo_text, oracle
from ballast.operators import freshness, registry, retention
from ballast.plans import jobs
from ballast.sources import files, text

_VERSIONS = (
    "'\"1.0.0\":{\"deprecated\":\"' || CASE WHEN p_size % 3 = 0 THEN 'old' ELSE '' END || '\"},\"1.1.' || p_size || '\":{'"
    " || CASE WHEN p_partkey % 4 = 0 THEN '\"deprecated\":\"gone\"' ELSE '' END || '},\"2.0.0\":{\"deprecated\":true}'"
)
_BODY = (
    "CASE WHEN p_partkey % 17 = 0 THEN '{bad' ELSE '{\"name\":\"p' || p_partkey || '\"' ||"
    " CASE WHEN p_partkey % 5 <> 0 THEN ',\"dist-tags\":{\"latest\":\"1.1.' || p_size || '\"}' ELSE '' END ||"
    " CASE WHEN p_partkey % 3 = 0 THEN ',\"modified\":\"2024-01-0' || (p_size % 9 + 1) || 'T00:00:00Z\"' ELSE '' END ||"
    f" ',\"versions\":{{' || {_VERSIONS} || '}}}}' END"
)


@register(
    "S5_flatten_packuments",
    """SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 5 <> 0 THEN '1.1.' || p_size END AS latest_version,
       CASE WHEN p_partkey % 3 = 0 THEN '2024-01-0' || (p_size % 9 + 1) || 'T00:00:00Z' END AS latest_published_at,
       concat_ws(',', CASE WHEN p_size % 3 = 0 THEN '1.0.0' END, CASE WHEN p_partkey % 4 = 0 THEN '1.1.' || p_size END) AS deprecated
       FROM part WHERE p_partkey % 17 <> 0""",
)
def s5(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("'p' || p_partkey AS name", f"{_BODY} AS body")
    flat = registry.flatten_packuments(raw)
    return flat.select(
        "name", "latest_version", "latest_published_at", F.array_join("deprecated_versions", ",").alias("deprecated")
    )


_MANIFEST = (
    "CASE WHEN o_orderkey % 23 = 0 THEN '{\"dependencies\"' ELSE '{' || chr(10) || '\"dependencies\":{' || chr(10) || '\"r' || (o_custkey % 140) || '\":\"^1.0\",'"
    " || chr(10) || '\"r' || (o_custkey % 140 + 1) || '\":{\"x\":1}},' || chr(10) || '\"devDependencies\":{\"r' || (o_orderkey % 140) || '\":\"~2\",\"n\":4},'"
    " || '\"peerDependencies\":[],\"optionalDependencies\":{' || CASE WHEN o_orderkey % 2 = 0 THEN '\"opt' || o_orderkey || '\":\"*\"' ELSE '' END || '}}' END"
)
_MANIFEST_ROWS = """SELECT 'w' || (o_orderkey % 20) AS workspace, '/repo/m' || o_orderkey || '/package.json' AS manifest_path, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 23 <> 0"""
_DECLARED = """SELECT workspace, manifest_path, 'dependencies' AS section, 'r' || (o_custkey % 140) AS name, '^1.0' AS version_range, CAST(2 AS BIGINT) AS line FROM manifests
  UNION ALL SELECT workspace, manifest_path, 'devDependencies', 'r' || (o_orderkey % 140), '~2', CAST(4 AS BIGINT) FROM manifests
  UNION ALL SELECT workspace, manifest_path, 'optionalDependencies', 'opt' || o_orderkey, '*', CAST(4 AS BIGINT) FROM manifests WHERE o_orderkey % 2 = 0"""


def _manifests(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "'w' || (o_orderkey % 20) AS workspace",
        "'/repo/m' || o_orderkey || '/package.json' AS manifest_path",
        f"{_MANIFEST} AS json",
    )


@register("S4_manifest_dependencies", oracle("SELECT * FROM declared", manifests=_MANIFEST_ROWS, declared=_DECLARED))
def s4(spark, sf_dir):
    return text.manifest_dependencies(_manifests(spark, sf_dir))


@register(
    "S4_dependency_names",
    oracle("SELECT DISTINCT workspace, name FROM declared", manifests=_MANIFEST_ROWS, declared=_DECLARED),
)
def s4_names(spark, sf_dir):
    return text.dependency_names(text.manifest_dependencies(_manifests(spark, sf_dir)), ["workspace"])


_HINTS = """SELECT d.*, r.latest_version, r.latest_published_at, r.updated_at AS fetched_at, d.installed_version = r.latest_version AS is_latest,
  CASE WHEN r.name IS NOT NULL AND d.installed_version IS NOT NULL THEN coalesce(r.deprecated = d.installed_version, false) END AS is_deprecated
  FROM dependencies d LEFT JOIN registry r ON r.name = d.name"""


@register(
    "J4_registry_hints",
    oracle("SELECT position, name, latest_version, fetched_at, is_latest, is_deprecated AS deprecated FROM hints", "dependencies", "registry", hints=_HINTS),
)
def j4(spark, sf_dir):
    hints = registry.registry_hints(view(spark, sf_dir, "dependencies"), view(spark, sf_dir, "registry"))
    return hints.select("position", "name", "latest_version", "fetched_at", "is_latest", "deprecated")


@register(
    "J13_newer_hint",
    """WITH cur AS (SELECT s_suppkey AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 * 10 END AS at FROM supplier WHERE s_suppkey % 5 <> 0),
       inc AS (SELECT s_suppkey AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 6 * 10 END AS at FROM supplier WHERE s_suppkey % 6 <> 0)
       SELECT name, CASE WHEN side = 'old' THEN o ELSE n END AS fetched_at, CASE WHEN (side = 'old' AND o IS NULL) OR (side = 'new' AND n IS NULL) THEN NULL ELSE side END AS origin FROM
       (SELECT coalesce(c.name, i.name) AS name, c.at AS o, i.at AS n, CASE WHEN i.at IS NULL OR (c.at IS NOT NULL AND c.at > i.at) THEN 'old' ELSE 'new' END AS side
        FROM cur c FULL JOIN inc i ON i.name = c.name)""",
)
def j13(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    current = supplier.where("s_suppkey % 5 <> 0").selectExpr(
        "s_suppkey AS name",
        "CASE WHEN s_suppkey % 4 <> 0 THEN named_struct('fetched_at', s_suppkey % 7 * 10, 'origin', 'old') END AS hint",
    )
    incoming = supplier.where("s_suppkey % 6 <> 0").selectExpr(
        "s_suppkey AS name",
        "CASE WHEN s_suppkey % 3 <> 0 THEN named_struct('fetched_at', s_suppkey % 6 * 10, 'origin', 'new') END AS hint",
    )
    return registry.newer_hint(current, incoming, ["name"]).select("name", "hint.fetched_at", "hint.origin")


@register(
    "J20_registry_union_merge",
    """SELECT name, CASE WHEN m.at IS NULL OR d.at > m.at THEN d.at ELSE m.at END AS updated_at, CASE WHEN m.at IS NULL OR d.at > m.at THEN 'disk' ELSE 'memory' END AS latest_version
       FROM (SELECT p_partkey AS name, CAST(p_size % 5 AS BIGINT) AS at FROM part WHERE p_partkey % 3 <> 0) d
       FULL JOIN (SELECT p_partkey AS name, CAST(p_size % 7 AS BIGINT) AS at FROM part WHERE p_partkey % 4 <> 0) m USING (name)""",
)
def j20(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    disk = part.where("p_partkey % 3 <> 0").selectExpr(
        "p_partkey AS name", "CAST(p_size % 5 AS BIGINT) AS updated_at", "'disk' AS latest_version"
    )
    memory = part.where("p_partkey % 4 <> 0").selectExpr(
        "p_partkey AS name", "CAST(p_size % 7 AS BIGINT) AS updated_at", "'memory' AS latest_version"
    )
    return registry.union_merge(disk, memory)


_REGISTRY_ROWS = """SELECT 'k' || o_orderkey AS name, 1704240000000 - (o_custkey * 7919 % 4000) * 1000000 AS updated_at, CAST(floor(o_totalprice / 100) AS BIGINT) AS size_bytes FROM orders"""
_REGISTRY_CAP = 900_000


@register(
    "W6_registry_retention",
    f"""WITH entries AS ({_REGISTRY_ROWS}), live AS (SELECT * FROM entries WHERE {NOW_MS} - updated_at <= 2592000000),
        run AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY updated_at, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM live)
        SELECT name, 'expired' AS reason FROM entries WHERE {NOW_MS} - updated_at > 2592000000
        UNION ALL SELECT name, 'over_budget' FROM run WHERE before < total - {_REGISTRY_CAP}""",
)
def w6(spark, sf_dir):
    return registry.registry_retention(_registry_entries(spark, sf_dir), NOW_MS, _REGISTRY_CAP).select("name", "reason")


def _registry_entries(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "'k' || o_orderkey AS name",
        "1704240000000 - (o_custkey * 7919 % 4000) * 1000000 AS updated_at",
        "CAST(floor(o_totalprice / 100) AS BIGINT) AS size_bytes",
    )


@register(
    "W6_entry_footprint",
    oracle(
        """SELECT name, CAST(length(name) + 4 + length('{' || concat_ws(',', '"latest_version":"' || latest_version || '"', '"latest_published_at":"' || latest_published_at || '"',
             '"deprecated_versions":[' || coalesce('"' || deprecated || '"', '') || ']', '"updated_at":' || updated_at, '"retry_after":' || retry_after,
             '"error":"' || error || '"', '"not_found":' || CASE WHEN not_found THEN 'true' ELSE 'false' END) || '}') AS BIGINT) AS size_bytes FROM registry""",
        "registry",
    ),
)
def w6_footprint(spark, sf_dir):
    return view(spark, sf_dir, "registry").select("name", registry.entry_footprint().alias("size_bytes"))


@register(
    "A12_section_summary",
    oracle(
        f"""SELECT workspace, manifest_path, section, total, measured, combined_bytes, missing, unavailable, loading,
            CASE WHEN measured = 0 AND missing = 0 AND unavailable = 0 AND loading > 0 THEN loading || ' checking...' ELSE
              concat_ws(' · ', measured || '/' || total || ' measured', {kilo_text('combined_bytes')} || ' br combined',
                CASE WHEN missing > 0 THEN missing || ' not installed' END, CASE WHEN unavailable > 0 THEN unavailable || ' unavailable' END) END AS label
            FROM (SELECT workspace, manifest_path, section, count(*) AS total, count(*) FILTER (WHERE status = 'ready' AND brotli_bytes IS NOT NULL) AS measured,
              CAST(coalesce(sum(brotli_bytes) FILTER (WHERE status = 'ready'), 0) AS BIGINT) AS combined_bytes, count(*) FILTER (WHERE status = 'missing') AS missing,
              count(*) FILTER (WHERE status = 'unavailable' OR (status = 'ready' AND brotli_bytes IS NULL)) AS unavailable, count(*) FILTER (WHERE status = 'loading') AS loading
              FROM dependencies GROUP BY workspace, manifest_path, section)""",
        "dependencies",
    ),
)
def a12(spark, sf_dir):
    return registry.section_summary(view(spark, sf_dir, "dependencies"))


_INSTALLED_COPIES = "SELECT 'w' || (p_partkey % 20) AS workspace, '/repo' AS dir, 'r' || (p_partkey % 140) AS package_name, max('1.' || (p_size % 4) || '.0') AS version FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2, 3"
_PACKAGE_SIZES = "SELECT name AS package_name, max(brotli_bytes) AS brotli_bytes FROM dependencies WHERE position % 4 <> 0 GROUP BY name"


_GUIDED = f"""SELECT d.*, c.dir, r.published_ms, z.brotli_bytes, z.package_name IS NOT NULL AS stored,
    CASE WHEN c.dir IS NULL THEN 'missing' WHEN z.package_name IS NULL THEN 'loading' ELSE 'ready' END AS status,
    CASE WHEN r.latest_version IS NULL THEN CASE WHEN stale THEN 'registry stale' END ELSE CASE WHEN stale THEN 'stale · ' ELSE '' END
      || CASE WHEN c.dir IS NULL THEN 'install ' || r.latest_version WHEN c.version = r.latest_version THEN 'latest' ELSE 'update ' || r.latest_version END END AS suffix, r.latest_version
  FROM declared d LEFT JOIN copies c ON c.workspace = d.workspace AND c.package_name = d.name LEFT JOIN sizes z ON z.package_name = d.name
  LEFT JOIN (SELECT *, NOT (CASE WHEN latest_version IS NOT NULL THEN {NOW_MS} - updated_at <= 21600000 ELSE not_found AND {NOW_MS} - updated_at <= 21600000 END
    OR coalesce(retry_after > {NOW_MS}, false)) AS stale FROM registry) r ON r.name = d.name"""
_GUIDANCE_VIEWS = {"manifests": _MANIFEST_ROWS, "declared": _DECLARED, "copies": _INSTALLED_COPIES, "sizes": _PACKAGE_SIZES, "guided": _GUIDED}


@register(
    "Q4_manifest_guidance",
    oracle(
        f"""SELECT manifest_path, section, name, CASE WHEN dir IS NULL THEN 'not_installed' WHEN NOT stored THEN 'checking' WHEN brotli_bytes IS NULL THEN 'unavailable' ELSE 'measured' END AS state,
            CASE WHEN suffix IS NOT NULL AND latest_version IS NOT NULL AND status <> 'missing' AND {NOW_MS} - published_ms BETWEEN 0 AND 86399999 THEN '✦ ' || suffix ELSE suffix END AS version_status FROM guided""",
        "registry", "dependencies", **_GUIDANCE_VIEWS,
    ),
)
def q4(spark, sf_dir):
    return _guidance(spark, sf_dir).select("manifest_path", "section", "name", "state", "version_status")


@register(
    "Q4_manifest_sections",
    oracle(
        f"""SELECT workspace, manifest_path, section, total, measured, CASE WHEN measured = 0 AND missing = 0 AND unavailable = 0 AND loading > 0 THEN loading || ' checking...'
              ELSE concat_ws(' · ', measured || '/' || total || ' measured', {kilo_text('combined')} || ' br combined',
                CASE WHEN missing > 0 THEN missing || ' not installed' END, CASE WHEN unavailable > 0 THEN unavailable || ' unavailable' END) END AS label
            FROM (SELECT workspace, manifest_path, section, count(*) AS total, count(*) FILTER (WHERE status = 'ready' AND brotli_bytes IS NOT NULL) AS measured,
              CAST(coalesce(sum(brotli_bytes) FILTER (WHERE status = 'ready'), 0) AS BIGINT) AS combined, count(*) FILTER (WHERE status = 'missing') AS missing,
              count(*) FILTER (WHERE status = 'ready' AND brotli_bytes IS NULL) AS unavailable, count(*) FILTER (WHERE status = 'loading') AS loading FROM guided GROUP BY ALL)""",
        "registry", "dependencies", **_GUIDANCE_VIEWS,
    ),
)
def q4_sections(spark, sf_dir):
    return jobs.guidance_sections(_guidance(spark, sf_dir)).select("workspace", "manifest_path", "section", "total", "measured", "label")


def _guidance(spark, sf_dir):
    copies = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr(
        "'w' || (p_partkey % 20) AS workspace", "'/repo' AS dir", "'r' || (p_partkey % 140) AS package_name", "'1.' || (p_size % 4) || '.0' AS version"
    )
    sizes = (
        view(spark, sf_dir, "dependencies").where("position % 4 <> 0").groupBy(F.col("name").alias("package_name"))
        .agg(*[F.max("brotli_bytes").alias(size) for size in ("raw_bytes", "minified_bytes", "gzip_bytes", "brotli_bytes", "zstd_bytes")])
        .withColumn("diagnostics", F.array().cast("array<struct<stage:string>>"))
    )
    return jobs.manifest_guidance(_manifests(spark, sf_dir), copies, sizes, view(spark, sf_dir, "registry"), NOW_MS)


# ---- freshness --------------------------------------------------------------
def _checked(strict: bool) -> str:
    first = "NOT contains(path, '/node_modules/') AND content_hash IS NOT NULL" if strict else "false"
    return f"""SELECT identity, path, CASE WHEN absent THEN CASE WHEN now_len IS NULL THEN 'fresh' WHEN NOT readable THEN 'unknown' ELSE 'stale' END
      WHEN now_len IS NULL THEN 'gone' WHEN NOT readable THEN 'unknown' WHEN NOT ({first}) AND len = now_len AND modified_millis = now_millis THEN 'fresh'
      WHEN content_hash IS NULL THEN 'stale' WHEN content_hash = now_hash THEN 'fresh' ELSE 'stale' END AS freshness
      FROM (SELECT f.*, c.len AS now_len, c.modified_millis AS now_millis, c.content_hash AS now_hash, c.readable FROM fingerprints f LEFT JOIN current_files c ON c.path = f.path)"""


_WORST = """SELECT identity, CASE max(CASE freshness WHEN 'unknown' THEN 4 WHEN 'gone' THEN 3 WHEN 'stale' THEN 2 ELSE 1 END)
  WHEN 4 THEN 'unknown' WHEN 3 THEN 'gone' WHEN 2 THEN 'stale' ELSE 'fresh' END AS freshness FROM checked GROUP BY identity"""


def _fresh(spark, sf_dir, strict=False):
    return freshness.stale_measurements(
        view(spark, sf_dir, "fingerprints"), view(spark, sf_dir, "current_files"), strict
    )


@register("J7_stale_measurements", oracle("SELECT * FROM checked", "fingerprints", "current_files", checked=_checked(False)))
def j7(spark, sf_dir):
    return _fresh(spark, sf_dir).select("identity", "path", "freshness")


@register("J7_stale_measurements_strict", oracle("SELECT * FROM checked", "fingerprints", "current_files", checked=_checked(True)))
def j7_strict(spark, sf_dir):
    return _fresh(spark, sf_dir, True).select("identity", "path", "freshness")


@register("A15_worst_freshness", oracle(_WORST, "fingerprints", "current_files", checked=_checked(False)))
def a15(spark, sf_dir):
    return freshness.worst_freshness(_fresh(spark, sf_dir), ["identity"])


@register(
    "Q8_incremental_worklist",
    oracle(f"SELECT * FROM ({_WORST}) WHERE freshness IN ('stale', 'gone')", "fingerprints", "current_files", checked=_checked(True)),
)
def q8(spark, sf_dir):
    return jobs.incremental_worklist(
        view(spark, sf_dir, "fingerprints"), view(spark, sf_dir, "current_files"), ["identity"]
    )


_SNAPSHOTS = "SELECT 'i' || (o_orderkey % 400) AS identity, 'f' || (o_custkey % 50) AS path, o_custkey % 50 + (o_orderkey % 40) // 39 AS len, CAST(7 AS BIGINT) AS modified_millis, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 + (o_orderkey % 27) // 26 END AS content_hash FROM orders"


@register(
    "A16_conflicting_snapshots",
    f"""SELECT identity, bool_or(n > 1 OR h > 1) AS conflicting FROM (SELECT identity, path, count(DISTINCT (len, modified_millis)) AS n, count(DISTINCT content_hash) AS h
        FROM ({_SNAPSHOTS}) GROUP BY identity, path) GROUP BY identity""",
)
def a16(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "'i' || (o_orderkey % 400) AS identity",
        "'f' || (o_custkey % 50) AS path",
        "o_custkey % 50 + (o_orderkey % 40) div 39 AS len",
        "CAST(7 AS BIGINT) AS modified_millis",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 + (o_orderkey % 27) div 26 END AS content_hash",
    )
    return freshness.conflicting_snapshots(rows, ["identity"])


@register(
    "U2_fingerprint_union_distinct",
    oracle(
        """SELECT path, len FROM fingerprints UNION SELECT path, len FROM current_files UNION SELECT path, len FROM current_files""",
        "fingerprints", "current_files",
    ),
)
def u2(spark, sf_dir):
    stored = view(spark, sf_dir, "fingerprints").select("path", "len")
    current = view(spark, sf_dir, "current_files").select("path", "len")
    return freshness.union_distinct(stored, current, current)


@register(
    "S9_fingerprint_files",
    """SELECT doc_id, replace('d' || chr(92) || doc_id, chr(92), '/') AS path, CASE WHEN doc_id % 9 = 0 THEN 9223372036854775807 ELSE n_chars END AS len,
       CASE WHEN doc_id % 9 = 0 THEN 9223372036854775807 ELSE doc_id * 1000 END AS modified_millis, doc_id % 9 <> 0 AS hashed,
       CASE WHEN doc_id % 9 <> 0 THEN count(*) OVER (PARTITION BY CASE WHEN doc_id % 9 <> 0 THEN text ELSE 'x' || doc_id END) ELSE 1 END AS same_content FROM documents""",
)
def s9(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "'d' || chr(92) || doc_id AS path",
        "n_chars AS len",
        "doc_id * 1000 AS modified_millis",
        "CASE WHEN doc_id % 9 <> 0 THEN encode(text, 'UTF-8') END AS content",
    )
    printed = files.fingerprint_files(listed)
    counts = printed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("same_content")
    )
    return printed.join(counts, "content_hash", "left").select(
        "doc_id",
        "path",
        "len",
        "modified_millis",
        F.col("content_hash").isNotNull().alias("hashed"),
        F.coalesce("same_content", F.lit(1)).alias("same_content"),
    )


@register(
    "H1_file_signature",
    oracle(
        """SELECT source_file, count(DISTINCT token) AS tokens, count(*) OVER (PARTITION BY string_agg(token || ':' || n, ';' ORDER BY token)) AS same_signature
           FROM (SELECT source_file, token, count(*) AS n FROM (SELECT 'f' || (o_orderkey % 5000) AS source_file, 't' || (o_custkey % 4) AS token FROM orders) GROUP BY 1, 2) GROUP BY source_file""",
    ),
)
def h1(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").selectExpr(
        "'f' || (o_orderkey % 5000) AS source_file", "'t' || (o_custkey % 4) AS token"
    )
    signed = freshness.file_signature(tokens, ["source_file"])
    same = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("same_signature"))
    return signed.join(same, "signature").select("source_file", "tokens", "same_signature")


@register(
    "J14_measurement_worklist",
    oracle(
        """SELECT DISTINCT workspace, name, version, kind AS import_kind FROM (SELECT workspace, name, installed_version AS version, has_default, unnest(['default', 'namespace']) AS kind
             FROM dependencies WHERE installed_version IS NOT NULL) w WHERE (kind = 'namespace' OR has_default)
           AND (workspace, name, version, kind) NOT IN (SELECT (workspace, name, installed_version, CASE WHEN position % 2 = 0 THEN 'default' ELSE 'namespace' END) FROM dependencies
             WHERE installed_version IS NOT NULL AND position % 7 < 3)""",
        "dependencies",
    ),
)
def j14(spark, sf_dir):
    deps = view(spark, sf_dir, "dependencies").where("installed_version IS NOT NULL")
    installed = deps.select("workspace", "name", F.col("installed_version").alias("version"), "has_default")
    stored = deps.where("position % 7 < 3").selectExpr(
        "workspace", "name", "installed_version AS version", "CASE WHEN position % 2 = 0 THEN 'default' ELSE 'namespace' END AS import_kind"
    )
    return freshness.measurement_worklist(installed, stored)


@register(
    "J17_invalidate_packages",
    oracle(
        "SELECT shard_id, key FROM store WHERE package_name NOT IN (SELECT 'p' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)",
        "store",
    ),
)
def j17(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").selectExpr("'p' || n_nationkey AS package_name")
    return freshness.invalidate_packages(view(spark, sf_dir, "store"), names).select("shard_id", "key")


@register(
    "A19_cache_outcome_counts",
    oracle(
        """SELECT request, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'stale') AS stale,
           count(*) FILTER (WHERE outcome = 'unverified') AS unverified FROM store GROUP BY request""",
        "store",
    ),
)
def a19(spark, sf_dir):
    return freshness.cache_outcomes(view(spark, sf_dir, "store"), ["request"])


# ---- store ------------------------------------------------------------------
_BUDGET = 2_000_000_000


@register(
    "A13_store_rollup",
    oracle(
        f"""SELECT shard_id, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS entry_count, min(last_seq) AS oldest_seq, CAST(1 AS BIGINT) AS project_count, CAST(NULL AS BIGINT) AS headroom_bytes FROM store GROUP BY shard_id
            UNION ALL SELECT NULL, CAST(sum(size_bytes) AS BIGINT), count(*), min(last_seq), count(DISTINCT shard_id), CAST(greatest(0, {_BUDGET} - sum(size_bytes)) AS BIGINT) FROM store""",
        "store",
    ),
)
def a13(spark, sf_dir):
    return retention.order_shards(retention.store_rollup(view(spark, sf_dir, "store"), _BUDGET))


def _plan_sql(source: str) -> str:
    return f"""SELECT shard_id, key, size_bytes FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY last_seq, shard_id, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY last_seq DESC, key) AS newest FROM {source}) WHERE newest > 4)
      WHERE before < (SELECT CASE WHEN sum(size_bytes) > cap THEN sum(size_bytes) - CAST(floor(cap * 0.9) AS BIGINT) ELSE 0 END FROM {source}, caps GROUP BY cap)"""


_CAPS = "SELECT CAST(sum(size_bytes) AS BIGINT) // 2 AS cap FROM store"


_PLANNED = ["shard_id", "key", "last_seq", "size_bytes"]


def _half(store):
    return store.agg(F.sum("size_bytes")).first()[0] // 2


@register("W5_retention_plan", oracle(_plan_sql("store"), "store", caps=_CAPS))
def w5(spark, sf_dir):
    store = view(spark, sf_dir, "store").select(*_PLANNED)
    return retention.retention_plan(store, _half(store), floor_rows=4).select("shard_id", "key", "size_bytes")


@register(
    "W5_retention_outcome",
    oracle(
        f"""SELECT count(*) AS evicted_keys, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS evicted_bytes, CAST((SELECT sum(size_bytes) FROM store) - coalesce(sum(size_bytes), 0) AS BIGINT) AS left_bytes,
            (SELECT sum(size_bytes) FROM store) - coalesce(sum(size_bytes), 0) > (SELECT cap FROM caps) AS still_over_budget FROM ({_plan_sql('store')})""",
        "store", caps=_CAPS,
    ),
)
def w5_outcome(spark, sf_dir):
    store = view(spark, sf_dir, "store").select(*_PLANNED)
    budget = _half(store)
    return retention.retention_outcome(store, retention.retention_plan(store, budget, floor_rows=4), budget)


@register(
    "W7_recent_keys",
    oracle(
        """SELECT shard_id, key, last_seq FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY last_seq DESC, key) AS n FROM store) WHERE n <= 50""",
        "store",
    ),
)
def w7(spark, sf_dir):
    return retention.recent_keys(view(spark, sf_dir, "store"), 50).select("shard_id", "key", "last_seq")


@register(
    "W10_recency",
    oracle("SELECT package_name AS key, max(CASE WHEN intent = 'interactive' THEN seq END) AS last_seq FROM store GROUP BY package_name", "store"),
)
def w10(spark, sf_dir):
    events = view(spark, sf_dir, "store").select(F.col("package_name").alias("key"), "seq", "intent")
    return retention.recency(events)


@register(
    "Q7_store_maintenance",
    oracle(
        f"""SELECT shard_id, key, size_bytes, 'orphan' AS reason FROM orphans UNION ALL SELECT shard_id, key, size_bytes, 'over_budget' FROM ({_plan_sql('kept').replace('newest > 4', 'newest > 128')})""",
        "store", "live_paths",
        orphans="""SELECT * FROM store WHERE analyzer_version <> 'v8' OR (entry_path IS NOT NULL AND entry_path NOT IN (SELECT path FROM live_paths))
           OR package_root NOT IN (SELECT path FROM live_paths)""",
        kept="SELECT * FROM store WHERE (shard_id, key) NOT IN (SELECT (shard_id, key) FROM orphans)",
        caps="SELECT CAST(sum(size_bytes) AS BIGINT) // 8 AS cap FROM store",
    ),
)
def q7(spark, sf_dir):
    store = view(spark, sf_dir, "store")
    budget = store.agg(F.sum("size_bytes")).first()[0] // 8
    return jobs.store_maintenance(store, view(spark, sf_dir, "live_paths"), "v8", budget)


@register(
    "Q7_full_maintenance",
    oracle(
        f"""SELECT shard_id, key, size_bytes, 'orphan' AS reason FROM orphans UNION ALL SELECT shard_id, key, size_bytes, 'over_budget' FROM ({_plan_sql('kept').replace('newest > 4', 'newest > 128')})
            UNION ALL SELECT NULL, name, size_bytes, 'expired' FROM entries WHERE {NOW_MS} - updated_at > 2592000000
            UNION ALL SELECT NULL, name, size_bytes, 'over_budget' FROM run WHERE before < total - {_REGISTRY_CAP}""",
        "store", "live_paths",
        orphans="""SELECT * FROM store WHERE analyzer_version <> 'v8' OR (entry_path IS NOT NULL AND entry_path NOT IN (SELECT path FROM live_paths))
           OR package_root NOT IN (SELECT path FROM live_paths)""",
        kept="SELECT * FROM store WHERE (shard_id, key) NOT IN (SELECT (shard_id, key) FROM orphans)",
        caps="SELECT CAST(sum(size_bytes) AS BIGINT) // 8 AS cap FROM store",
        entries=_REGISTRY_ROWS,
        live=f"SELECT * FROM entries WHERE {NOW_MS} - updated_at <= 2592000000",
        run="""SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY updated_at, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM live""",
    ),
)
def q7_full(spark, sf_dir):
    store = view(spark, sf_dir, "store")
    budget = store.agg(F.sum("size_bytes")).first()[0] // 8
    return jobs.full_maintenance(store, view(spark, sf_dir, "live_paths"), "v8", budget, _registry_entries(spark, sf_dir), NOW_MS, _REGISTRY_CAP)


@register(
    "Q7_store_rollup_after",
    oracle(
        f"""SELECT shard_id, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS entry_count, min(last_seq) AS oldest_seq, CAST(1 AS BIGINT) AS project_count, CAST(NULL AS BIGINT) AS headroom_bytes FROM left_ GROUP BY shard_id
            UNION ALL SELECT NULL, CAST(sum(size_bytes) AS BIGINT), count(*), min(last_seq), count(DISTINCT shard_id), CAST(greatest(0, (SELECT cap FROM caps) - sum(size_bytes)) AS BIGINT) FROM left_""",
        "store", "live_paths",
        orphans="""SELECT * FROM store WHERE analyzer_version <> 'v8' OR (entry_path IS NOT NULL AND entry_path NOT IN (SELECT path FROM live_paths))
           OR package_root NOT IN (SELECT path FROM live_paths)""",
        kept="SELECT * FROM store WHERE (shard_id, key) NOT IN (SELECT (shard_id, key) FROM orphans)",
        caps="SELECT CAST(sum(size_bytes) AS BIGINT) // 8 AS cap FROM store",
        gone=_plan_sql("kept").replace("newest > 4", "newest > 128"),
        left_="SELECT * FROM kept WHERE (shard_id, key) NOT IN (SELECT (shard_id, key) FROM gone)",
    ),
)
def q7_after(spark, sf_dir):
    store = view(spark, sf_dir, "store")
    budget = store.agg(F.sum("size_bytes")).first()[0] // 8
    deleted = jobs.store_maintenance(store, view(spark, sf_dir, "live_paths"), "v8", budget)
    return jobs.store_after(store, deleted, budget)


_STORED = {
    "identity": "'i' || (o_orderkey % 900)",
    "workspace": "'w' || (o_orderkey % 20)",
    "name": "'p' || (o_custkey % 50)",
    "version": "'1.' || (o_custkey % 3)",
    "import_kind": "CASE WHEN o_orderkey % 2 = 0 THEN 'default' ELSE 'namespace' END",
}
_INSTALLED = {**{name: _STORED[name] for name in ("workspace", "name", "version")}, "has_default": "(o_custkey % 50 % 3 <> 0)"}


def _listed(columns):
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


@register(
    "Q8_remeasure_worklist",
    oracle(
        """SELECT DISTINCT w.* FROM (SELECT workspace, name, version, unnest(CASE WHEN has_default THEN ['default', 'namespace'] ELSE ['namespace'] END) AS import_kind FROM installed) w
           ANTI JOIN (SELECT * FROM stored WHERE identity NOT IN (SELECT identity FROM worst WHERE freshness IN ('stale', 'gone'))) h
             ON h.workspace = w.workspace AND h.name = w.name AND h.version = w.version AND h.import_kind = w.import_kind""",
        "fingerprints", "current_files",
        checked=_checked(True), worst=_WORST,
        stored=f"SELECT {_listed(_STORED)} FROM orders", installed=f"SELECT DISTINCT {_listed(_INSTALLED)} FROM orders",
    ),
)
def q8_remeasure(spark, sf_dir):
    # contents stand where the view has hashes; a file that cannot be read has none
    content = F.encode(F.concat(F.lit("c"), F.col("content_hash").cast("string")), "UTF-8")
    fingerprints = view(spark, sf_dir, "fingerprints").withColumn(
        "content_hash", F.when(F.col("content_hash").isNotNull(), F.xxhash64(content))
    )
    current = view(spark, sf_dir, "current_files").withColumn("content", F.when(F.col("readable"), content))
    orders = table(spark, sf_dir, "orders")
    return jobs.remeasure_worklist(
        fingerprints,
        current.drop("readable", "content_hash"),
        orders.selectExpr(*[f"{text} AS {name}" for name, text in _STORED.items()]),
        orders.selectExpr(*[f"{text} AS {name}" for name, text in _INSTALLED.items()]).distinct(),
    )
