"""Specifier and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast import vocabulary as V

_URL_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_RELATIVE = r"^(?:\./|\.\./|/|\\\\|\.\\|\.\.\\|[A-Za-z]:[\\/])"
_VIRTUAL = r"^(?:\$|#|@/|~/)"


def package_name(specifier: Column) -> Column:
    """The package a specifier belongs to."""
    return F.when(
        specifier.startswith("@") & specifier.contains("/"),
        F.regexp_extract(specifier, r"(?s)^([^/]*/[^/]*)", 1),
    ).otherwise(F.split_part(specifier, F.lit("/"), F.lit(1)))


def is_node_builtin(specifier: Column) -> Column:
    bare = F.regexp_replace(specifier, "^node:", "")
    return specifier.isin(V.NODE_PREFIXED_ONLY) | bare.isin(V.NODE_MODULES)


def is_url_like(specifier: Column) -> Column:
    return specifier.rlike(_URL_SCHEME)


def is_runtime_package(specifier: Column) -> Column:
    """Whether a specifier names an installable package."""
    return ~(
        specifier.rlike(_RELATIVE)
        | is_node_builtin(specifier)
        | is_url_like(specifier)
        | specifier.rlike(_VIRTUAL)
        | specifier.isin(V.HOST_MODULES)
    )


def is_safe_package_name(name: Column) -> Column:
    """scope/name shape without path tricks."""
    segment = r"(?!\.{1,2}(?:/|\z))[^/\\:]+"
    return name.rlike(rf"(?s)\A(?:@(?!/)[^/\\:]+/{segment}|(?!@){segment})\z")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_source_file(workspace: Column, path: Column) -> Column:
    """The path below the workspace root."""
    root = F.regexp_replace(workspace, "/+$", "")
    inside = path.startswith(F.concat(root, F.lit("/"))) | (path == root)
    below = F.when(inside, F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    return F.regexp_replace(slashed(below), "^/+", "")


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def is_vendored(path: Column) -> Column:
    text = slashed(path)
    return (
        text.contains("/vendor/")
        | text.contains("/vendors/")
        | text.contains("/vendored/")
        | (F.size(F.split(text, "/node_modules/")) > 2)
    )


def is_first_party(path: Column) -> Column:
    """No `node_modules` segment."""
    return ~F.array_contains(F.split(path, "/"), "node_modules")


def normal_root(root: Column) -> Column:
    text = F.regexp_replace(slashed(root), "/+$", "")
    return F.when(text.rlike("^.:"), F.lower(text)).otherwise(text)


def shard_id(root: Column) -> Column:
    """Partition key of a project root."""
    return F.lower(F.lpad(F.hex(F.xxhash64(normal_root(root))), 16, "0"))


def package_of_manifest_path(path: Column) -> Column:
    """The package below the last `node_modules`, NULL when there is none."""
    text = slashed(path)
    tail = F.regexp_replace(F.substring_index(text, "/node_modules/", -1), "/package\\.json$", "")
    return F.when(text.contains("/node_modules/"), package_name(tail))


def is_workspace_config(path: Column) -> Column:
    """A compiler config outside node_modules."""
    text = slashed(path)
    return F.substring_index(text, "/", -1).rlike(r"^(?:ts|js)config(?:\.[^./\\]+)?\.json$") & (
        is_first_party(text)
    )


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def classify_asset(path: Column) -> Column:
    """P5: css / wasm / font / unmeasured, NULL for anything else."""
    ext = extension(path)
    return (
        F.when(ext.isin(V.CSS_EXTENSIONS), "css")
        .when(ext.isin(V.WASM_EXTENSIONS), "wasm")
        .when(ext.isin(V.FONT_EXTENSIONS), "font")
        .when(ext.isin(V.UNMEASURED_EXTENSIONS), "unmeasured")
    )


def ancestors(directory: Column) -> Column:
    """All folders from the root down to `directory`, as an array of paths."""
    parts = F.split(directory, "/")
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    )


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")
