"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_SIZES = [
    T.StructField(name, T.LongType())
    for name in ("raw_bytes", "minified_bytes", "gzip_bytes", "brotli_bytes", "zstd_bytes")
]

DIAGNOSTIC = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", T.ArrayType(T.StringType())),
    ]
)
MODULE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType())]
)
ASSET = T.StructType([T.StructField("kind", T.StringType()), *_SIZES])

SOURCE_FILES = T.StructType(
    [
        T.StructField("workspace", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.StringType()),
    ]
)
IMPORT_SITES = T.StructType(
    [
        T.StructField("workspace", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("line", T.LongType()),
        T.StructField("stmt_start_line", T.LongType()),
        T.StructField("stmt_end_line", T.LongType()),
        T.StructField("specifier", T.StringType(), False),
        T.StructField("package_name", T.StringType()),
        T.StructField("import_kind", T.StringType()),
        T.StructField("syntax", T.StringType()),
        T.StructField("runtime", T.StringType()),
        T.StructField("named", T.ArrayType(T.StringType())),
    ]
)
MEASUREMENTS = T.StructType(
    [
        T.StructField("specifier", T.StringType(), False),
        T.StructField("import_kind", T.StringType()),
        T.StructField("runtime", T.StringType()),
        T.StructField("named", T.ArrayType(T.StringType())),
        *_SIZES,
        T.StructField("side_effects", T.BooleanType()),
        T.StructField("truly_treeshakeable", T.BooleanType()),
        T.StructField("is_cjs", T.BooleanType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("confidence_reasons", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("unmeasured_stage", T.StringType()),
        T.StructField("diagnostics", T.ArrayType(DIAGNOSTIC)),
        T.StructField("module_breakdown", T.ArrayType(MODULE)),
        T.StructField("shared_bytes", T.LongType()),
        T.StructField("asset_breakdown", T.ArrayType(ASSET)),
        T.StructField("freshness", T.StringType()),
    ]
)
REGISTRY_METADATA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("latest_version", T.StringType()),
        T.StructField("latest_published_at", T.StringType()),
        T.StructField("deprecated_versions", T.ArrayType(T.StringType())),
        T.StructField("updated_at", T.LongType()),
        T.StructField("retry_after", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("not_found", T.BooleanType()),
    ]
)
CHANGE_EVENTS = T.StructType(
    [
        T.StructField("workspace", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("path", T.StringType()),
    ]
)
