"""Fixpoints over module graphs: semi-naive rounds, each one pinned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.session import pinned

ROUNDS_BEFORE_MERGE = 8


def _fixpoint(seed: DataFrame, step, keys: list[str]) -> DataFrame:
    """Apply `step` to the newest rows until nothing new appears.

    Each round joins only the newest rows and drops what is known by an anti
    join. Rounds are written out; known rows are merged now and then so that
    the union stays short.
    """
    newest = pinned(seed.select(*keys).distinct())
    known = [newest]
    while not newest.isEmpty():
        seen = reduce(DataFrame.unionByName, known)
        newest = pinned(step(newest).select(*keys).distinct().join(seen, keys, "left_anti"))
        known.append(newest)
        if len(known) > ROUNDS_BEFORE_MERGE:
            known = [pinned(reduce(DataFrame.unionByName, known))]
    return reduce(DataFrame.unionByName, known)


def reachable_modules(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Every module reachable from the entries of each (graph, runtime)."""
    keys = ["graph_id", "runtime", "module_path"]
    links = pinned(edges.select("graph_id", "from_path", "to_path").distinct())

    def step(newest: DataFrame) -> DataFrame:
        return newest.withColumnRenamed("module_path", "from_path").join(
            links, ["graph_id", "from_path"]
        ).select("graph_id", "runtime", F.col("to_path").alias("module_path"))

    return _fixpoint(entries, step, keys)


def graph_limits(
    reached: DataFrame,
    sizes: DataFrame,
    max_modules: int = V.GRAPH_MAX_MODULES,
    max_module_bytes: int = V.GRAPH_MAX_MODULE_BYTES,
    max_total_bytes: int = V.GRAPH_MAX_TOTAL_BYTES,
) -> DataFrame:
    """Count and bytes per (graph, runtime) with the limit verdict."""
    weighed = reached.join(sizes, ["graph_id", "module_path"], "left")
    rolled = weighed.groupBy("graph_id", "runtime").agg(
        F.count(F.lit(1)).alias("modules"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("bytes"), F.lit(0)).alias("largest_bytes"),
    )
    over = (
        (F.col("modules") > max_modules)
        | (F.col("largest_bytes") > max_module_bytes)
        | (F.col("total_bytes") > max_total_bytes)
    )
    return rolled.withColumn("stage", F.when(over, "module_graph_limit"))


def export_surface(export_edges: DataFrame) -> DataFrame:
    """Names visible from each module.

    `export_edges` has module, kind (own / named / star), name, target and
    source_name. An own or named export hides a star export of the same name; a
    star never forwards `default`; a name that reaches a module from two
    different origins over stars is ambiguous and dropped.
    """
    key = ["module", "name"]
    own = export_edges.where(F.col("kind") == "own").select(
        "module", "name", F.col("module").alias("origin_module"), F.col("name").alias("origin_name")
    )
    modules = export_edges.select(F.col("module").alias("target")).distinct()
    named = pinned(
        export_edges.where(F.col("kind") == "named")
        .select("module", "name", "target", F.coalesce("source_name", "name").alias("source_name"))
        .distinct()
    )
    outside = named.join(modules, "target", "left_anti").select(
        "module",
        "name",
        F.col("target").alias("origin_module"),
        F.col("source_name").alias("origin_name"),
    )
    stars = pinned(
        export_edges.where(F.col("kind") == "star").select("module", "target").distinct()
    )
    explicit = pinned(
        export_edges.where(F.col("kind").isin("own", "named")).select("module", "name").distinct()
    )

    def step(newest: DataFrame) -> DataFrame:
        seen = newest.withColumnRenamed("module", "target")
        over_names = named.join(
            seen.withColumnRenamed("name", "source_name"), ["target", "source_name"]
        ).select("module", "name", *_ORIGIN)
        over_stars = (
            stars.join(seen.where(F.col("name") != "default"), "target")
            .select("module", "name", *_ORIGIN)
            .join(explicit, key, "left_anti")
        )
        return over_names.unionByName(over_stars)

    # a name is new, has one origin, or is ambiguous: it can change twice, however many origins
    # lead to it, and what it hands on is its one origin or that it is ambiguous
    first = own.unionByName(outside).withColumn("ambiguous", F.lit(False))
    newest = pinned(_met(first, key).select(*key, *_ORIGIN))
    known = [newest]
    while not newest.isEmpty():
        held = _held(reduce(DataFrame.unionByName, known), key)
        found = _met(step(newest), key).join(held, key, "left")
        other = ~F.col("origin_module").eqNullSafe(F.col("_module")) | ~F.col("origin_name").eqNullSafe(F.col("_name"))
        unknown = F.col("_ambiguous").isNull()
        ambiguous = F.col("ambiguous") | (~unknown & other)
        newest = pinned(
            found.where(unknown | (ambiguous & ~F.col("_ambiguous"))).select(
                *key,
                F.when(unknown, F.col("origin_module")).otherwise(F.col("_module")).alias("origin_module"),
                F.when(unknown, F.col("origin_name")).otherwise(F.col("_name")).alias("origin_name"),
                ambiguous.alias("ambiguous"),
            )
        )
        known.append(newest)
        if len(known) > ROUNDS_BEFORE_MERGE:
            known = [pinned(reduce(DataFrame.unionByName, known))]
    return (
        _held(reduce(DataFrame.unionByName, known), key)
        .where(~F.col("_ambiguous"))
        .select(*key, F.col("_module").alias("origin_module"), F.col("_name").alias("origin_name"))
    )


_ORIGIN = ["origin_module", "origin_name", "ambiguous"]


def _met(rows: DataFrame, key: list[str]) -> DataFrame:
    """One origin of each name among `rows`, and whether there is another."""
    origin = F.struct("origin_module", "origin_name")
    met = rows.groupBy(*key).agg(
        F.min(origin).alias("_low"), F.max(origin).alias("_high"), F.bool_or("ambiguous").alias("_some")
    )
    return met.select(*key, "_low.*", (F.col("_some") | ~F.col("_low").eqNullSafe(F.col("_high"))).alias("ambiguous"))


def _held(known: DataFrame, key: list[str]) -> DataFrame:
    """What is known of each name. It keeps its first origin, so its rows differ in `ambiguous` only."""
    return known.groupBy(*key).agg(
        F.min("origin_module").alias("_module"), F.min("origin_name").alias("_name"), F.bool_or("ambiguous").alias("_ambiguous")
    )


def export_names(surface: DataFrame) -> DataFrame:
    """The list offered to a reader leaves `default` out."""
    return surface.where(F.col("name") != "default")
