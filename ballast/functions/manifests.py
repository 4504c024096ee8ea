"""Predicates over a package manifest held as a VARIANT column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import globs, specifiers


def parsed(manifest_json: Column) -> Column:
    """Bad JSON becomes NULL instead of failing the job."""
    return F.try_parse_json(manifest_json)


def _text(variant: Column, path: str) -> Column:
    """A string field; any other type is NULL."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _strings(items: Column) -> Column:
    kept = F.filter(items, lambda item: F.schema_of_variant(item) == "STRING")
    return F.transform(kept, lambda item: item.cast("string"))


def side_effects_mode(manifest: Column) -> Column:
    """Which form `sideEffects` takes."""
    value = F.try_variant_get(manifest, "$.sideEffects", "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing")
        .when((kind == "BOOLEAN") & value.cast("boolean"), "true")
        .when(kind == "BOOLEAN", "false")
        .when((kind == "STRING") | kind.startswith("ARRAY"), "array")
        .otherwise("unknown")
    )


def has_side_effects(manifest: Column, entry: Column) -> Column:
    """Whether `entry` (package-relative) is declared effectful."""
    value = F.try_variant_get(manifest, "$.sideEffects", "variant")
    kind = F.schema_of_variant(value)
    many = _strings(F.try_variant_get(manifest, "$.sideEffects", "array<variant>"))
    patterns = F.when(kind == "STRING", F.array(value.cast("string"))).otherwise(many)
    path = F.regexp_replace(entry, r"^(?:\./)+", "")
    matched = F.exists(patterns, lambda pattern: F.rlike(path, globs.package_glob(pattern)))
    mode = side_effects_mode(manifest)
    return F.when(mode == "false", False).when(mode == "array", matched).otherwise(True)


def _normal_target(target: Column) -> Column:
    return F.regexp_replace(target, r"^(?:\./)+", "")


def _nesting(text: Column) -> Column:
    """How deep objects and arrays of a JSON text nest."""
    brackets = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"|[^\[\]{}]', "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(
        steps,
        start,
        lambda held, step: F.struct(
            (held["now"] + step).alias("now"), F.greatest(held["most"], held["now"] + step).alias("most")
        ),
    )["most"]


def _export_leaves(value: Column) -> Column:
    """Every value below `value` that is no object or array, with the keys that lead to it; an
    array step is recorded as an empty key. One pass opens one level, as many as the value has."""
    item = "struct<keys:array<string>,value:variant>"

    def opened(found: Column) -> Column:
        kind = F.schema_of_variant(found["value"])
        fields = F.map_entries(F.try_variant_get(found["value"], "$", "map<string,variant>"))
        items = F.try_variant_get(found["value"], "$", "array<variant>")

        def below(key: Column, child: Column) -> Column:
            return F.struct(F.array_append(found["keys"], key).alias("keys"), child.alias("value")).cast(item)

        return (
            F.when(kind.startswith("OBJECT"), F.transform(fields, lambda field: below(field["key"], field["value"])))
            .when(kind.startswith("ARRAY"), F.transform(items, lambda child: below(F.lit(""), child)))
            .otherwise(F.array(found))
            .cast(f"array<{item}>")
        )

    start = F.array(F.struct(F.array().cast("array<string>").alias("keys"), value.alias("value"))).cast(f"array<{item}>")
    levels = F.sequence(F.lit(1), F.greatest(_nesting(F.to_json(value)), F.lit(1)))
    return F.aggregate(levels, start, lambda held, _: F.flatten(F.transform(held, opened)).cast(f"array<{item}>"))


def _exports_point_to(manifest: Column, entry: Column, conditions: list[str]) -> Column:
    """Whether a condition leads to `entry`; a condition inside an array counts
    only below another condition."""
    exports = F.try_variant_get(manifest, "$.exports", "variant")
    wanted = F.array(*[F.lit(name) for name in conditions])

    def hit(leaf: Column) -> Column:
        first_array = F.array_position(leaf["keys"], "")
        reachable = F.when(
            first_array > 0, F.slice(leaf["keys"], F.lit(1), first_array.cast("int") - 1)
        ).otherwise(leaf["keys"])
        text = F.when(F.schema_of_variant(leaf["value"]) == "STRING", leaf["value"].cast("string"))
        return F.arrays_overlap(reachable, wanted) & (_normal_target(text) == entry)

    return F.coalesce(F.exists(_export_leaves(exports), hit), F.lit(False))


def is_commonjs(manifest: Column, entry: Column) -> Column:
    """Module system of a resolved, package-relative entry."""
    ext = F.regexp_extract(entry, r"[^/]\.([^./]*)$", 1)

    def field_is_entry(name: str) -> Column:
        return F.coalesce(_normal_target(_text(manifest, f"$.{name}")) == entry, F.lit(False))

    kind = _text(manifest, "$.type")
    return (
        F.when(ext.isin("cjs", "cts"), True)
        .when(ext.isin("mjs", "mts", "ts", "tsx", "jsx", "json"), False)
        .when(field_is_entry("module") | field_is_entry("browser"), False)
        .when(_exports_point_to(manifest, entry, ["browser", "import"]), False)
        .when(_exports_point_to(manifest, entry, ["require"]), True)
        .when(kind == "module", False)
        .when(kind == "commonjs", True)
        .otherwise(field_is_entry("main") | (ext == "js"))
    )


def is_native_backed(manifest: Column) -> Column:
    """An optional dependency carries a platform suffix."""
    names = F.map_keys(F.try_variant_get(manifest, "$.optionalDependencies", "map<string,variant>"))
    suffix = (
        r"(?:\A|-)(?:" + "|".join(V.OS_TOKENS) + r")-(?:" + "|".join(V.ARCH_TOKENS) + r")"
        r"(?:-(?:" + "|".join(V.LIBC_TOKENS) + r"))?\z"
    )
    return F.coalesce(
        F.exists(names, lambda name: F.substring_index(name, "/", -1).rlike(suffix)), F.lit(False)
    )


def is_native_only(manifest: Column) -> Column:
    """Native-backed and without any JavaScript entry field."""
    absent = F.lit(True)
    for name in ("main", "module", "browser", "exports"):
        absent = absent & F.try_variant_get(manifest, f"$.{name}", "variant").isNull()
    return is_native_backed(manifest) & absent


def installed_version(manifest: Column) -> Column:
    """The version string, `unknown` where the manifest has none."""
    return F.coalesce(_text(manifest, "$.version"), F.lit("unknown"))


__all__ = [
    "parsed", "side_effects_mode", "has_side_effects", "is_commonjs", "is_native_backed",
    "is_native_only", "installed_version", "specifiers",
]
