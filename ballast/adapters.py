"""Views of the driver's tables as the engine's tables.

Each view is one projection, written once and used by both engines: Spark reads
it as expressions over parquet, the oracle as a SELECT. Arrays are added on the
Spark side from the scalar columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import identity as I
from ballast.functions import quality as Q

_UNMEASURED = "(l_linestatus = 'F' AND l_discount > 0.08)"
_PRICE = "CAST(floor(l_extendedprice) AS BIGINT)"
_DIAG1 = (
    "CASE l_partkey % 13 WHEN 0 THEN 'asset_io' WHEN 1 THEN 'imprecise_assets' WHEN 2 THEN 'external'"
    " WHEN 3 THEN 'uncounted_assets' WHEN 4 THEN 'types_only' WHEN 5 THEN 'native_binary'"
    " WHEN 6 THEN 'native_binary_only' WHEN 7 THEN 'strange' END"
)
_DIAG2 = "CASE l_suppkey % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'external' END"


def _size(expression: str) -> str:
    return f"CASE WHEN NOT {_UNMEASURED} THEN {expression} END"


_SITE = {
    "workspace": "'w' || (l_orderkey % 20)",
    "workspace_root": "'/repo/w' || (l_orderkey % 20)",
    "source_file": "'/repo/w' || (l_orderkey % 20) || '/src/d' || (l_orderkey % 9) || '/f' || l_orderkey || '.ts'",
    "site": "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)",
    "line": "CAST(l_linenumber AS BIGINT)",
    "stmt_start_line": "CAST(l_linenumber * 3 AS BIGINT)",
    "stmt_end_line": "CAST(l_linenumber * 3 + l_partkey % 3 AS BIGINT)",
    "package_name": "'@s' || (l_suppkey % 7) || '/p' || (l_partkey % 200)",
    "specifier": "'@s' || (l_suppkey % 7) || '/p' || (l_partkey % 200) || CASE WHEN l_partkey % 9 = 0 THEN '/sub' ELSE '' END",
    "runtime": "CASE l_returnflag WHEN 'A' THEN 'server' WHEN 'N' THEN 'client' ELSE 'component' END",
    "import_kind": "CASE l_linenumber % 3 WHEN 0 THEN 'namespace' WHEN 1 THEN 'named' ELSE 'default' END",
    "syntax": "CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 0 THEN 'star_reexport' ELSE 'static' END",
    "n1": "'n' || (l_partkey % 5)",
    "n2": "'n' || (l_suppkey % 5)",
    "status": "CASE l_suppkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'loading' WHEN 2 THEN 'unavailable' ELSE 'ready' END",
    "raw_bytes": _size(f"{_PRICE} * 4"),
    "minified_bytes": _size(f"{_PRICE} * 3"),
    "gzip_bytes": _size(f"{_PRICE} + {_PRICE} // 8"),
    "brotli_bytes": _size(_PRICE),
    "zstd_bytes": f"CASE WHEN NOT {_UNMEASURED} AND l_partkey % 97 <> 0 THEN {_PRICE} + {_PRICE} // 16 END",
    "side_effects": "(l_quantity > 40)",
    "is_cjs": "(l_tax > 0.06)",
    "truly_treeshakeable": "(l_discount < 0.05)",
    "diag1": _DIAG1,
    "diag2": _DIAG2,
    "unmeasured_stage": f"CASE WHEN {_UNMEASURED} THEN CASE l_partkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'timeout' WHEN 2 THEN 'link' ELSE 'strange' END END",
    "error": f"CASE WHEN {_UNMEASURED} THEN 'build failed' END",
    "warning": "CASE WHEN l_linenumber = 7 THEN 'check by hand' END",
    "shared_bytes": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_quantity) AS BIGINT) END",
    "m1": "'/repo/node_modules/m' || l_suppkey || '/index.js'",
    "m1_bytes": f"{_PRICE} // 10",
    "m2": "CASE WHEN l_suppkey % 5 = 0 THEN '/repo/node_modules/a/node_modules/m' || l_suppkey || '/b.js' ELSE '/repo/node_modules/m' || ((l_suppkey * 7) % 100) || '/index.js' END",
    "m2_bytes": f"{_PRICE} // 20",
    "ts_ms": "epoch_us(l_shipdate) // 1000",
}

VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "sites": ("lineitem", _SITE, None),
    "budgets": (
        "nation",
        {
            "workspace": "'w' || n_nationkey",
            "per_import_brotli_bytes": "CASE WHEN n_nationkey <> 0 THEN CAST(80000 - n_nationkey * 1000 AS BIGINT) END",
            "per_file_brotli_bytes": "CASE WHEN n_nationkey % 7 <> 0 THEN CAST(200000 AS BIGINT) END",
        },
        None,
    ),
    "specs": (
        "part",
        {
            "id": "p_partkey",
            "specifier": "CASE p_partkey % 30 WHEN 0 THEN './local/x' || p_partkey WHEN 1 THEN '../up/' || p_partkey"
            " WHEN 2 THEN '/abs/' || p_partkey WHEN 3 THEN '@scope' || (p_partkey % 7) || '/pkg' || p_partkey || '/deep/file.js'"
            " WHEN 4 THEN '@scope' || p_partkey WHEN 5 THEN 'pkg' || p_partkey || '/sub' WHEN 6 THEN 'node:fs'"
            " WHEN 7 THEN 'fs/promises' WHEN 8 THEN 'https:' || '/' || '/cdn/x' || p_partkey WHEN 9 THEN '$lib/x' || p_partkey"
            " WHEN 10 THEN '#internal' || p_partkey WHEN 11 THEN '@/components/' || p_partkey WHEN 12 THEN '~/x' || p_partkey"
            " WHEN 13 THEN 'astro:content' WHEN 14 THEN 'virtual:pwa' WHEN 15 THEN 'vscode' WHEN 16 THEN 'electron'"
            " WHEN 17 THEN 'bun:test' WHEN 18 THEN 'C:/dev/x' || p_partkey WHEN 19 THEN 'node:test' WHEN 20 THEN 'test'"
            " WHEN 21 THEN 'pkg..' || p_partkey WHEN 22 THEN '..' WHEN 23 THEN '.' WHEN 24 THEN 'lodash/' || p_partkey"
            " WHEN 25 THEN 'moment' WHEN 26 THEN 'uuid/v4' WHEN 27 THEN '@scope/..' WHEN 28 THEN 'a:b' ELSE 'pkg-' || p_partkey END",
        },
        None,
    ),
    "paths": (
        "part",
        {
            "id": "p_partkey",
            "path": "CASE p_partkey % 12 WHEN 0 THEN '/w/node_modules/a' || p_partkey || '/package.json'"
            " WHEN 1 THEN '/w/node_modules/@s/b' || p_partkey || '/package.json' WHEN 2 THEN '/w/src/vendor/x' || p_partkey || '.WOFF2'"
            " WHEN 3 THEN '/w/node_modules/a/node_modules/c' || p_partkey || '/lib/i.css' WHEN 4 THEN '/w/tsconfig.json'"
            " WHEN 5 THEN '/w/pkg' || p_partkey || '/jsconfig.base.json' WHEN 6 THEN '/w/node_modules/a/tsconfig.json'"
            " WHEN 7 THEN '/w/img/p' || p_partkey || '.png' WHEN 8 THEN '/w/m' || p_partkey || '.wasm' WHEN 9 THEN '/w/.css'"
            " WHEN 10 THEN 'C:/Proj' || (p_partkey % 50) || '/' ELSE '/w/src/f' || p_partkey || '.ts' END",
        },
        None,
    ),
    "cost_history": (
        "events",
        {
            "workspace": "'w' || (user_id % 20)",
            "file_name": "'/src/u' || user_id || '.ts'",
            "event_id": "event_id",
            "ts_ms": "epoch_us(ts) // 1000",
            "raw_bytes": "CAST(floor(value * 100) AS BIGINT) // 50 * 4",
            "minified_bytes": "CAST(floor(value * 100) AS BIGINT) // 50 * 3",
            "gzip_bytes": "CAST(floor(value * 100) AS BIGINT) // 50 * 2",
            "brotli_bytes": "CAST(floor(value * 100) AS BIGINT)",
            "zstd_bytes": "CAST(floor(value * 100) AS BIGINT) // 50",
            "imprecise": "(event_type = 'error')",
            "import_count": "event_id % 9 + 1",
        },
        None,
    ),
    "changes": (
        "events",
        {
            "workspace": "'w' || (user_id % 4)",
            "event_id": "event_id",
            "ts_ms": "epoch_us(ts) // 1000",
            "path": "CASE event_id % 9 WHEN 0 THEN '/w/tsconfig.json' WHEN 1 THEN '' WHEN 2 THEN '/w/node_modules/x/jsconfig.json'"
            " ELSE '/w/node_modules/u' || (user_id % 60) || '/package.json' END",
        },
        None,
    ),
    "checks": (
        "events",
        {
            "key": "'k' || (user_id % 50)",
            "ts_ms": "epoch_us(ts) // 1000",
            "seq": "event_id",
            "outcome": "CASE event_type WHEN 'error' THEN 'fresh' ELSE CASE WHEN event_id % 5 = 0 THEN 'stale' ELSE 'unknown' END END",
        },
        None,
    ),
    "logs": (
        "events",
        {
            "event_id": "event_id",
            "ts_ms": "epoch_us(ts) // 1000",
            "request": "user_id % 40",
            "specifier": "'p' || (event_id % 30)",
            "detail": "event_type",
            "line": "CASE WHEN event_id % 10 = 0 THEN 'free text ' || event_id ELSE '  [sizer] 2024-01-01T00:00:00Z ['"
            " || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'info' WHEN 'view' THEN 'Warn' ELSE 'debug' END || ']'"
            " || CASE WHEN user_id % 5 = 0 THEN '' ELSE ' [c' || (user_id % 5) || ']' END || ' event ' || event_id || ' done ' END",
        },
        None,
    ),
    "requests": (
        "events",
        {
            "name": "'pkg' || (user_id % 25)",
            "workspace": "'w' || (user_id % 20)",
            "document": "'/src/u' || user_id || '.ts'",
            "request_id": "event_id",
            "ts_ms": "epoch_us(ts) // 1000",
            "seq": "event_id",
            "manual": "(event_type = 'click')",
            "succeeds": "(event_id % 4 <> 0)",
        },
        None,
    ),
    "store": (
        "orders",
        {
            "shard_id": "'s' || (o_custkey % 25)",
            "key": "'k' || o_orderkey",
            "last_seq": "(o_orderkey * 7919) % 1000003",
            "size_bytes": "CAST(floor(o_totalprice) AS BIGINT)",
            "analyzer_version": "CASE WHEN o_orderkey % 19 = 0 THEN 'v7' ELSE 'v8' END",
            "package_name": "'p' || (o_custkey % 40)",
            "entry_path": "CASE WHEN o_orderkey % 23 <> 0 THEN '/e' || o_orderkey END",
            "package_root": "'/r' || (o_custkey % 200)",
            "seq": "o_orderkey",
            "intent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'interactive' ELSE 'bulk' END",
            "outcome": "CASE o_orderstatus WHEN 'F' THEN 'hit' WHEN 'O' THEN 'stale' ELSE 'unverified' END",
            "request": "o_custkey % 300",
        },
        None,
    ),
    "live_paths": (
        "orders",
        {"path": "CASE WHEN o_orderkey % 2 = 0 THEN '/e' || (o_orderkey // 2) ELSE '/r' || (o_custkey % 200) END"},
        "o_orderkey % 7 <> 0",
    ),
    "fingerprints": (
        "orders",
        {
            "identity": "'i' || (o_orderkey % 900)",
            "path": "CASE WHEN o_orderkey % 3 = 0 THEN '/w/src/f' ELSE '/w/node_modules/f' END || o_orderkey",
            "len": "CAST(floor(o_totalprice) AS BIGINT)",
            "modified_millis": "o_custkey * 1000",
            "content_hash": "CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * 31 + o_orderkey END",
            "absent": "(o_orderkey % 29 = 0)",
        },
        None,
    ),
    "current_files": (
        "orders",
        {
            "path": "CASE WHEN o_orderkey % 3 = 0 THEN '/w/src/f' ELSE '/w/node_modules/f' END || o_orderkey",
            "len": "CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END",
            "modified_millis": "o_custkey * 1000 + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END",
            "content_hash": "o_custkey * 31 + o_orderkey + CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 31 = 0 THEN 1 ELSE 0 END",
            "readable": "(o_orderkey % 37 <> 0)",
        },
        "o_orderkey % 13 <> 0",
    ),
    "registry": (
        "supplier",
        {
            "name": "'r' || s_suppkey",
            "latest_version": "CASE WHEN s_suppkey % 9 <> 0 THEN '1.' || (CAST(floor(abs(s_acctbal)) AS BIGINT) % 4) || '.0' END",
            "latest_published_at": "CASE WHEN s_suppkey % 4 = 0 THEN '2024-01-02T06:00:00.000Z' ELSE '2023-05-01T00:00:00.000Z' END",
            "published_ms": "CASE WHEN s_suppkey % 4 = 0 THEN CAST(1704175200000 AS BIGINT) ELSE CAST(1682899200000 AS BIGINT) END",
            "deprecated": "CASE WHEN s_suppkey % 6 = 0 THEN '1.1.0' END",
            "updated_at": "CAST(1704240000000 AS BIGINT) - (s_suppkey % 12) * 3600000",
            "retry_after": "CASE WHEN s_suppkey % 8 = 0 THEN CAST(1704240000000 AS BIGINT) + (s_suppkey % 3 - 1) * 60000 END",
            "error": "CASE WHEN s_suppkey % 8 = 0 THEN 'rate limit' END",
            "not_found": "(s_suppkey % 9 = 0 AND s_suppkey % 2 = 0)",
        },
        None,
    ),
    "dependencies": (
        "part",
        {
            "workspace": "'w' || (p_partkey % 20)",
            "manifest_path": "'/m' || (p_partkey % 90) || '/package.json'",
            "section": "CASE p_size % 4 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'devDependencies' WHEN 2 THEN 'peerDependencies' ELSE 'optionalDependencies' END",
            "position": "p_partkey",
            "name": "'r' || (p_partkey % 140)",
            "installed_version": "CASE WHEN p_partkey % 5 <> 0 THEN '1.' || (p_size % 4) || '.0' END",
            "status": "CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'loading' WHEN p_partkey % 11 = 0 THEN 'unavailable' ELSE 'ready' END",
            "has_default": "(p_size % 3 <> 0)",
            "refresh": "CASE WHEN p_partkey % 6 = 0 THEN 'stale' END",
            "diag1": "CASE p_size % 10 WHEN 0 THEN 'types_only' WHEN 1 THEN 'native_binary_only' WHEN 2 THEN 'native_binary' END",
            "raw_bytes": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 4 END",
            "minified_bytes": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 3 END",
            "gzip_bytes": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 2 END",
            "brotli_bytes": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END",
            "zstd_bytes": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) + 7 END",
        },
        None,
    ),
    "edges": (
        "lineitem",
        {
            "graph_id": "'g' || (l_orderkey % 4)",
            "from_path": "'m' || l_suppkey",
            "to_path": "'m' || ((l_suppkey * 7 + l_linenumber) % 100)",
        },
        None,
    ),
    "entries": (
        "supplier",
        {
            "graph_id": "'g' || (s_suppkey % 4)",
            "runtime": "CASE s_nationkey % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'client' ELSE 'component' END",
            "module_path": "'m' || s_suppkey",
        },
        None,
    ),
}

NOW_MS = 1704240000000  # 2024-01-03T00:00:00Z, the reading time of the registry views


def _spark_text(expression: str) -> str:
    text = expression.replace(" // ", " div ")
    for column in ("ts", "l_shipdate", "o_orderdate"):
        text = text.replace(
            f"epoch_us({column})",
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))",
        )
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(frame: DataFrame, name: str) -> DataFrame:
    """A view's projection over a (batch or streaming) source table."""
    _, columns, condition = VIEWS[name]
    if condition:
        frame = frame.where(_spark_text(condition))
    return frame.selectExpr(*[f"{_spark_text(text)} AS {column}" for column, text in columns.items()])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_arrays(project(table(spark, sf_dir, VIEWS[name][0]), name))


def with_arrays(frame: DataFrame) -> DataFrame:
    """Array columns built from the scalar ones a view has."""
    columns = set(frame.columns)
    if "diag1" in columns:
        stages = [F.col(name) for name in ("diag1", "diag2") if name in columns]
        frame = frame.withColumn(
            "diagnostics",
            F.transform(
                F.filter(F.array(*stages), lambda stage: stage.isNotNull()),
                lambda stage: F.struct(stage.alias("stage")),
            ),
        )
    if "n1" in columns:
        frame = frame.withColumn(
            "named", I.sorted_names(F.col("import_kind"), F.array("n1", "n2"))
        )
    if "m1" in columns:
        frame = frame.withColumn(
            "module_breakdown",
            F.array(
                F.struct(F.col("m1").alias("path"), F.col("m1_bytes").alias("bytes")),
                F.struct(F.col("m2").alias("path"), F.col("m2_bytes").alias("bytes")),
            ),
        )
    if {"diag1", "side_effects"} <= columns:
        measured = Q.is_measured()
        frame = (
            frame.withColumn("has_result", F.col("status") == "ready")
            .withColumn("confidence", Q.confidence(measured, F.col("side_effects"), F.col("diagnostics")))
            .withColumn(
                "confidence_reasons",
                Q.confidence_reasons(measured, F.col("side_effects"), F.col("diagnostics")),
            )
        )
    if "deprecated" in columns:
        frame = frame.withColumn(
            "deprecated_versions",
            F.when(F.col("deprecated").isNotNull(), F.array("deprecated")).otherwise(
                F.array().cast("array<string>")
            ),
        ).drop("deprecated")
    return frame


def select_text(name: str) -> str:
    """The view as a SELECT for the oracle."""
    source, columns, condition = VIEWS[name]
    listed = ", ".join(f"{text} AS {column}" for column, text in columns.items())
    return f"SELECT {listed} FROM {source}" + (f" WHERE {condition}" if condition else "")
