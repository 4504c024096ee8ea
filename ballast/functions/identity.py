"""Identities and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_names(kind: Column, named: Column) -> Column:
    """Names count only for a named import, sorted and distinct."""
    empty = F.array().cast("array<string>")
    return F.when(kind == "named", F.array_sort(F.array_distinct(named))).otherwise(empty)


def import_identity(specifier: Column, kind: Column, runtime: Column, named: Column) -> Column:
    """One string per (specifier, kind, runtime, names)."""
    return F.concat_ws(
        "\u0000", specifier, kind, runtime, F.array_join(F.array_sort(named), "\u0001")
    )


def import_label(specifier: Column, kind: Column, named: Column) -> Column:
    """The identity as shown to a reader."""
    return (
        F.when(
            (kind == "named") & (F.size(named) > 0),
            F.concat(specifier, F.lit(" { "), F.array_join(named, ", "), F.lit(" }")),
        )
        .when(kind == "named", specifier)
        .otherwise(F.concat(specifier, F.lit(" ("), kind, F.lit(")")))
    )


def measurement_key(*parts: Column) -> Column:
    """A stable key over the identity of a stored measurement."""
    fields = [part.alias(f"p{position}") for position, part in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(*fields)), 256)
